"""What the tests of the training-data operators share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
