"""Prompt templates with named places, filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = re.compile(r"\{(\w+)\}")
TEMPLATES = {
    "sql_direct": "Database schema:\n{schema}\n\nQuestion:\n{question}\n\nAnswer with one SQL query in a ```sql block.",
    "sql_evidence": "Database schema:\n{schema}\n\nWhat is known:\n{evidence}\n\nQuestion:\n{question}\n\nAnswer with one SQL query in a ```sql block.",
    "sql_reasoned": "Database schema:\n{schema}\n\nQuestion:\n{question}\n\nWork out the tables, joins and conditions step by step, then give the query in a ```sql block.",
    "sql_repair": "Database schema:\n{schema}\n\nQuestion:\n{question}\n\nThis query failed:\n```sql\n{sql}\n```\nError: {error}\n\nGive a corrected query in a ```sql block.",
    "sql_compare": "Question:\n{question}\n\nYour query\n```sql\n{sql}\n```\ngave:\n{result}\n\nIf it answers the question repeat it, else give a better one, in a ```sql block.",
}


def filled(template: str, **columns: Column) -> Column:
    """A template, by name or as text, with its places filled; nulls are empty.  A place without a column is an error."""
    text = TEMPLATES.get(template, template)
    parts, at = [], 0
    for m in _PLACE.finditer(text):
        if m[1] not in columns:
            raise KeyError(f"no column for {{{m[1]}}}")
        parts += [F.lit(text[at : m.start()]), F.coalesce(columns[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
