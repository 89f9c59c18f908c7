"""Column expressions and the driver functions that mirror them."""
