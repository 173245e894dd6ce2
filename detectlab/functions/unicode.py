"""Unicode normal forms and named entities, on the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The static methods of the Unicode library that Spark itself ships for its collations.
_NORMALIZER = "com.ibm.icu.text.Normalizer"
_METHODS = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFD": ("decompose", False), "NFKD": ("decompose", True)}


def normal_form(text: Column, form: str) -> Column:
    """``text`` in a normal form. Text of ASCII alone is in every form and is passed by."""
    method, compatible = _METHODS[form]
    called = F.call_function("java_method", F.lit(_NORMALIZER), F.lit(method), text, F.lit(compatible))
    return F.when(text.rlike(r"[^\x00-\x7F]"), called).otherwise(text)


#: Names with the closing semicolon; the five of XML are left to the caller, who undoes ``&amp;`` last.
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and name[:-1] not in ("lt", "gt", "quot", "apos", "amp")}
_PAIR, _SIDE = "\x01", "\x02"
NAMED_ENTITY = "&[A-Za-z][A-Za-z0-9]{1,31};"


def named_entities() -> Column:
    """Entity names and their texts, as one map that the optimiser folds."""
    return F.str_to_map(F.lit(_PAIR.join(f"{name}{_SIDE}{text}" for name, text in _NAMED.items())), F.lit(_PAIR), F.lit(_SIDE))


def unescape_named(text: Column) -> Column:
    """All named entities of HTML but the five of XML; a name that there is not stays as it is."""
    pieces, found = F.split(text, NAMED_ENTITY), F.regexp_extract_all(text, F.lit(NAMED_ENTITY), F.lit(0))
    table = named_entities()
    joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("entity")), lambda x: F.concat(
        x["piece"], F.coalesce(F.try_element_at(table, F.substring(x["entity"], F.lit(2), F.length(x["entity"]) - 2)), x["entity"], F.lit("")))), "")
    return F.when(text.rlike(NAMED_ENTITY), joined).otherwise(text)
