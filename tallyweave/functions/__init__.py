"""Column functions: text, hashes, similarities and the fixed tables behind them."""
