"""JSON found inside free text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens.functions.text import bound, strip


def json_span(text: Column) -> Column:
    """Text without code fences, cut to its first ``{`` and last ``}`` where it has both."""

    def cut(bare: Column) -> Column:
        first = F.instr(bare, "{")
        last = F.length(bare) - F.instr(F.reverse(bare), "}") + 1
        both = (first > 0) & (F.instr(bare, "}") > 0)
        return F.when(both, F.substring(bare, first, last - first + 1)).otherwise(bare)

    return bound(strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))), cut)


def recover_json(text: Column, schema: str, fallback: Column | None = None) -> Column:
    """The JSON object inside ``text`` as a struct, or ``fallback`` (default NULL) if it is not one valid object.

    Parsing as a one-element array makes trailing content count as malformed.
    """
    wrapped = F.concat(F.lit("["), json_span(text), F.lit("]"))
    parsed = F.from_json(wrapped, f"array<{schema}>", {"allowSingleQuotes": "false"})
    found = bound(parsed, lambda p: F.when(F.size(p) == 1, F.get(p, 0)))
    return found if fallback is None else F.coalesce(found, fallback.cast(schema))


def recover_variant(text: Column, fallback: Column | None = None) -> Column:
    """The JSON object inside ``text`` as a variant with all its fields, or ``fallback`` (default NULL) if it is not one valid object.

    No schema is needed: ``variant_get``, ``to_json`` and ``variant_explode`` reach fields that nobody has named before.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), json_span(text), F.lit("]")))

    def one_object(found: Column) -> Column:
        first = F.variant_get(found, "$[0]", "variant")
        alone = F.variant_get(found, "$[1]", "variant").isNull() & F.startswith(F.schema_of_variant(first), F.lit("OBJECT"))
        return F.when(alone, first)

    kept = bound(wrapped, one_object)
    return kept if fallback is None else F.coalesce(kept, fallback)
