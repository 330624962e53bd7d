"""Small text rules of the normalisation step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document type to entity type.
ENTITY_TYPES = {"invoice": "invoice_line_item", "bank_statement": "bank_transaction", "gl_export": "gl_entry"}

# Words that decide a subtype, in order.
SUBTYPE_WORDS = (
    ("credit_note", "CREDIT MEMO|CREDIT NOTE|CREDITS"),
    ("refund", "REFUND|REIMBURSEMENT"),
    ("void", "VOID|VOIDED|REVERSAL|REVERSED"),
)


def strip(value: Column) -> Column:
    """Without white space at either end; a plain trim takes off spaces only."""
    return F.btrim(value, F.lit(" \t\r\n\f\u000b"))


def entity_type(doc_type: Column) -> Column:
    """Anything unknown counts as an invoice."""
    out = F
    for kind, value in ENTITY_TYPES.items():
        out = out.when(doc_type == kind, value)
    return out.otherwise("invoice_line_item")


def subtype(given: Column, description: Column) -> Column:
    """Only a standard entity is reclassified."""
    upper, out = F.upper(F.coalesce(description, F.lit(""))), F
    for value, words in SUBTYPE_WORDS:
        out = out.when(upper.rlike(words), value)
    return F.when(given == "standard", out.otherwise(given)).otherwise(given)


def ofx_description(name: Column, memo: Column, fitid: Column) -> Column:
    """N14."""
    return F.coalesce(F.concat(name, F.lit(" — "), memo), name, memo, fitid)


def transaction_ref(mapped: Column, *fallbacks: Column) -> Column:
    """The first present reference; a blank one counts as none."""
    return F.nullif(strip(F.coalesce(mapped, *fallbacks)), F.lit(""))


def salvage_json_array(text: Column) -> Column:
    """The JSON array inside a model's answer, as text; '[]' when there is none.

    A fenced block is preferred; if what remains is not an array, the part from the first to the
    last bracket is taken.
    """
    blanks = F.lit(" \t\r\n")
    body = F.btrim(text, blanks)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.btrim(F.when(body.rlike(r"(?s)```.*?```"), fenced).otherwise(body), blanks)
    bracketed = F.regexp_extract(inner, r"(?s)(\[.*\])", 1)

    def valid(t: Column) -> Column:
        return F.when(F.json_array_length(t).isNotNull(), t)

    return F.coalesce(valid(inner), valid(bracketed), F.lit("[]"))


def value_text(value: Column) -> Column:
    """A setting's value as text, null stays null."""
    return value.cast("string")
