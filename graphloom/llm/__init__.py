"""Training-data operators: ten DataFrame operators for text corpora and the queries that apply them."""
