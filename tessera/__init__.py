"""Code-intelligence analytics over DataFrames of source files, symbols and relations."""
__version__ = "2"
