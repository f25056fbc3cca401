"""Training-data operators (token counts, dedup, decontamination, language ID, PII, licences, encodings).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
