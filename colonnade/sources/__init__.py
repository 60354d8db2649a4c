"""Single-document file formats, their log, and a Spark data source for them."""
