TEXT = "doc_id long, text string, lang string, source string, n_chars long"
