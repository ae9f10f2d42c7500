"""qaflow: question-answering dataset work on Spark."""
