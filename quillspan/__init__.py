"""quillspan: conversation and document analytics declared as Spark DataFrame plans."""
