"""plaintide: customer-feedback labelling and reporting as Spark DataFrame operators."""
