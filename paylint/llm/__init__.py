"""Training-data operators: filters, joins, indexes, classifiers and writers over document tables."""
