"""ledgerline: a PySpark-native analytics engine for financial-institution data."""
