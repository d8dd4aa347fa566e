"""babelmill: bilingual-document and translation-workflow analytics on Spark DataFrames."""
