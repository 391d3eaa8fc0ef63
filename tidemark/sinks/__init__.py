"""Writers and the row-level rules that guard them."""
