"""Text functions: whitespace, fences, replies, entities, summaries, number cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, filled
from .rules import URL

#: An extraction reply's fields.
REPLY = (
    "company_name string, company_description string, transaction_type string, capital_sources array<string>, sectors array<string>, "
    "deal_type string, deal_amount string, investors string, strategic_significance string, market_implications string"
)


#: What counts as blank at a line's ends, and what ends a line: Unicode's blanks and the four separators of ASCII.
_BLANK = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"


def clean_whitespace(text: Column | str) -> Column:
    """Lines stripped and split at two blanks; the parts that aren't empty, stripped, with one blank between."""
    strip = lambda x: F.regexp_replace(x, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")
    lines = F.transform(F.split(col(text), _LINE_END), strip)
    chunks = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, "  "), strip)))
    return F.array_join(F.filter(chunks, lambda x: x != ""), " ")


def unfenced(reply: Column | str) -> Column:
    """What stands in the first json fence, else in the first fence; else the whole reply. A fence that isn't closed ends before the last character."""
    r = col(reply)
    named = F.regexp_extract(r, r"(?s)```json(.*?)(?:```|.\z)", 1)
    plain = F.regexp_extract(r, r"(?s)```(.*?)(?:```|.\z)", 1)
    return F.trim(F.when(F.contains(r, F.lit("```json")), named).when(F.contains(r, F.lit("```")), plain).otherwise(r))


def parsed_reply(reply: Column | str) -> Column:
    """The reply's fields; summary_complete tells whether it was JSON, and all fields are NULL if it wasn't. A text
    where a list belongs is NULL, and the other fields stay."""
    got = F.try_parse_json(unfenced(reply))  # one expression, so it is computed once for all fields
    fields = [x.split(" ", 1) for x in REPLY.split(", ")]
    return F.struct(*[F.try_variant_get(got, f"$.{n}", kind).alias(n) for n, kind in fields], got.isNotNull().alias("summary_complete"))


def links(text: Column | str, entities: Column | str | None = None, caption: Column | str | None = None) -> Column:
    """Links of a message in order: those in the text, entity links that it doesn't have yet, then all of the caption's.

    Entities are structs (type, offset, length); offsets count code points. A link that an entity repeats is left out.
    """
    found = lambda x: F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(URL), F.lit(0))
    out = found(text)
    if entities is not None:
        t = F.coalesce(col(text), F.lit(""))
        marked = F.transform(F.filter(F.coalesce(col(entities), F.array().cast("array<struct<type:string,offset:int,length:int>>")), lambda e: e["type"] == "url"), lambda e: t.substr(e["offset"] + 1, e["length"]))
        out = F.aggregate(marked, out, lambda have, u: F.when((u == "") | F.array_contains(have, u), have).otherwise(F.concat(have, F.array(u))))
    if caption is not None:
        out = F.concat(out, found(caption))
    return out


def refresh_target(content: Column | str) -> Column:
    """What follows the first lower-case url= of a refresh header, up to the next; NULL without one."""
    return F.when(F.contains(col(content), F.lit("url=")), F.get(F.split(col(content), "url="), 1))


def draft_summary(significance: Column | str, implications: Column | str) -> Column:
    """Two marked sections, those that are filled."""
    a = F.when(filled(significance).isNotNull(), F.concat(F.lit("**Why It Matters:** "), col(significance), F.lit("\n\n")))
    b = F.when(filled(implications).isNotNull(), F.concat(F.lit("**Market Implications:** "), col(implications)))
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def plain_summary(significance: Column | str, implications: Column | str) -> Column:
    a = F.coalesce(col(significance), F.lit(""))
    return F.concat(a, F.coalesce(F.concat(F.lit(" "), filled(implications)), F.lit("")))


def number_cell(text: Column | str) -> Column:
    """The number that a cell begins with, once $ and , are gone; NULL if it begins with none."""
    bare = F.regexp_replace(F.trim(col(text)), "[,$]", "")
    return F.regexp_extract(bare, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def items(n: Column | str) -> Column:
    return F.concat(col(n).cast("string"), F.when(col(n) == 1, " item").otherwise(" items"))


def truncated(text: Column | str, n: int, leeway: int = 5) -> Column:
    """Cut at the last blank before n characters, with dots; a text that is longer by the leeway at most stays whole."""
    t = col(text)
    return F.when(F.length(t) <= n + leeway, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n - 3), r"(?s) [^ ]*\z", ""), F.lit("...")))


def cell_order(cell: Column | str, descending: bool = False) -> list[Column]:
    """Sort keys of a table's column, as its header sorts it: numbers by value before texts in the order of a dictionary (root collation), or all of it the other way round. NULL comes last."""
    number, said = number_cell(cell), F.collate(F.trim(col(cell)), "UNICODE")
    if not descending:
        return [F.asc_nulls_last(number), F.asc_nulls_last(said)]
    return [F.when(number.isNull(), said).desc_nulls_last(), F.desc_nulls_last(number)]
