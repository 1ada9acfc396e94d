"""Backtest range of the registered queries; it spans every shipping and order date of the tables."""

START = "1995-01-01"
END = "2001-12-31"
