"""Typed tables from the text a language model returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium import fixed as V
from opinarium.functions.text import LEADING_DIGIT, split_lines, strip
from opinarium.operators.sections import section_lines, with_sections
from opinarium.schema import PLAN


def without_fence(text: Column) -> Column:
    """The content of a leading code fence, else the stripped text."""
    bare = strip(text)
    inside = F.get(F.split(bare, V.CODE_FENCE), F.lit(1))
    at = F.locate(V.CODE_FENCE_LANGUAGE, inside)
    unlabelled = F.when(
        at > 0,
        F.concat(
            F.substring(inside, F.lit(1), at - 1),
            F.substring(inside, at + len(V.CODE_FENCE_LANGUAGE), F.char_length(inside)),
        ),
    ).otherwise(inside)
    return F.when(F.startswith(bare, F.lit(V.CODE_FENCE)), strip(unlabelled)).otherwise(bare)


def _member(object_: Column, name: str) -> Column:
    """A member of a JSON object as a variant, whatever its type."""
    return F.try_variant_get(object_, f"$.{name}", "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text(value: Column) -> Column:
    """A variant's text; null unless it is a string."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _texts(value: Column) -> Column:
    """The strings of a variant; null unless it is an array. Elements of another type are left out."""
    items = F.when(_is(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    return F.filter(F.transform(items, _text), lambda item: item.isNotNull())


def _json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as a variant; null for any other.

    The parser stops after a first value, so the text is read as the only element of an array and as a member of an object: what
    follows a value breaks one of them.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    alone = member.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def parse_query_plans(raw: DataFrame, text: str = "raw", question: str = "question") -> DataFrame:
    """Typed query plans; text that is no JSON object falls back to the question itself without filters.

    Every member is read by its own type: a number, list or object where text belongs is as good as absent, and so is
    an element of ``search_queries`` that is no string. Nothing is turned into text.
    """
    parsed = raw.withColumn("_json", _json(without_fence(F.col(text))))
    plan = F.when(_is(F.col("_json"), "OBJECT"), F.col("_json"))
    members = parsed.withColumns({f"_{name}": _member(plan, name) for name in PLAN.names})
    queries = _texts(F.col("_search_queries"))
    return members.select(
        *[c for c in raw.columns if c not in (text, question)],
        F.when(F.size(queries) > 0, queries).otherwise(F.array(question)).alias("search_queries"),
        F.coalesce(_text(F.col("_sentiment")), F.lit(V.ANY_SENTIMENT)).alias("sentiment"),
        _text(F.col("_product_hint")).alias("product_hint"),
    )


def _items(df: DataFrame, id_column: str, parts: dict[str, Column]) -> DataFrame:
    """Arrays of items, one per section, as rows numbered from 1."""
    per_section = F.array(
        *[F.struct(F.lit(name).alias("section"), items.alias("items")) for name, items in parts.items()]
    )
    rows = df.select(id_column, F.explode(per_section).alias("p"))
    rows = rows.select(id_column, "p.section", F.posexplode("p.items").alias("_pos", "item"))
    return rows.select(id_column, "section", (F.col("_pos") + 1).alias("item_no"), "item")


def parse_pros_cons(texts: DataFrame, id_column: str = "text_id", text: str = "txt") -> DataFrame:
    """Numbered points below PROS and CONS headers: ``section``, ``item_no``, ``item``.

    Everything happens within the row: no explode of raw lines and no exchange.
    """

    def kind_of(line: Column) -> Column:
        upper = F.upper(line)
        return F.when(F.startswith(upper, F.lit(V.PROS_HEADER)), "pros").when(
            F.startswith(upper, F.lit(V.CONS_HEADER)), "cons"
        )

    lined = texts.withColumn("_lines", split_lines(F.col(text)))
    cut = with_sections(lined, "_lines", kind_of, "_sections")

    def points(kind: str) -> Column:
        numbered = F.filter(
            section_lines(F.col("_sections"), kind), lambda line: F.regexp_like(line, F.lit(LEADING_DIGIT))
        )
        return F.transform(numbered, lambda line: strip(F.regexp_replace(line, r"^[^.]*\.", "")))

    return _items(cut, id_column, {kind: points(kind) for kind in ("pros", "cons")})


def parse_compare(texts: DataFrame, id_column: str = "text_id", text: str = "txt") -> DataFrame:
    """Points won by each product and the verdict, from a comparison text."""

    def kind_of(line: Column) -> Column:
        bare = F.lower(strip(F.regexp_replace(line, V.HEADER_DECORATION, "")))
        return (
            F.when(F.contains(bare, F.lit(V.A_WINS_HEADER)), "a_wins")
            .when(F.contains(bare, F.lit(V.B_WINS_HEADER)), "b_wins")
            .when(F.startswith(bare, F.lit(V.VERDICT_HEADER)), "verdict")
        )

    def cleaned(line: Column) -> Column:
        return strip(F.regexp_replace(line, V.BULLET_LEAD, ""))

    lined = texts.withColumn("_lines", split_lines(F.col(text)))
    cut = with_sections(lined, "_lines", kind_of, "_sections")
    sections = F.col("_sections")

    def wins(kind: str) -> Column:
        return F.filter(F.transform(section_lines(sections, kind), cleaned), lambda item: item != "")

    def appended(so_far: Column, line: Column) -> Column:
        return F.concat(so_far, F.when(so_far == "", "").otherwise(" "), cleaned(line))

    def with_verdict(so_far: Column, section: Column) -> Column:
        inline = strip(F.regexp_replace(section["head"], V.VERDICT_LEAD, ""))
        return F.aggregate(section["body"], F.when(inline == "", so_far).otherwise(inline), appended)

    verdict = F.aggregate(F.filter(sections, lambda s: s["kind"] == "verdict"), F.lit(""), with_verdict)
    return _items(
        cut,
        id_column,
        {
            "a_wins": wins("a_wins"),
            "b_wins": wins("b_wins"),
            "verdict": F.filter(F.array(verdict), lambda v: v != ""),
        },
    )
