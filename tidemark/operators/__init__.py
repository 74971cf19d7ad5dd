"""Row-, pair- and series-operators."""
