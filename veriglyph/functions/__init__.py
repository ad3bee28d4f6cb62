"""Column functions and the tables behind them."""
