"""Training-data operators: token counts, URL filters, similarity joins, substring
removal, quality rules, packing, decontamination, language-model scoring and chat
formatting. Nothing outside this folder imports it but the guarded hook in
``__spark_entry__.py``.
"""
