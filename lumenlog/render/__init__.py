"""Reports and CSV files of analysed cases."""
