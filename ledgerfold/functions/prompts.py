"""Prompts for models that stand in for a default step: templates with named places, filled by a column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTRACT = "From the contract below, give the company name, the payment terms and the liability clauses.\n\n{contract_text}"
W9 = "From the W-9 form below, give the company name and the tax identifier, letter for letter.\n\n{w9_text}"
SAME_ENTITY = "Are these two names of one legal entity? Abbreviations, punctuation and legal forms don't count.\n\nIn the contract: {contract_name}\nIn the W-9: {w9_name}"
EXPLAIN = "In a sentence or two, say what speaks against approval. Use nothing but these findings.\n\n{findings}"


def filled(template: str, **values: Column) -> Column:
    """The template with a column's value in each place; a null value is an empty text. Braces in values stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))
