"""Document-to-retrieval jobs on Spark DataFrames.

files -> parts -> chunks -> vectors / labels -> hits -> context -> citations
"""
