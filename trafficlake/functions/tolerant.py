"""SQL expressions whose failing parts give NULL instead of ending the job."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Operators by Spark's class names, and the functions that give NULL where they fail.
_TRY = {
    "Add": "try_add({0}, {1})",
    "Subtract": "try_subtract({0}, {1})",
    "Multiply": "try_multiply({0}, {1})",
    "Divide": "try_divide({0}, {1})",
    "Remainder": "try_mod({0}, {1})",
    "IntegralDivide": "({0} DIV nullif({1}, 0))",
    "UnaryMinus": "try_subtract(0, {0})",
}

#: Functions that can fail, and what takes their place. A cast written as a function is a cast.
_SAFE = {"element_at": "try_element_at", "to_date": "try_to_date", "to_timestamp": "try_to_timestamp", "to_number": "try_to_number", "mod": "try_mod"}
_CASTS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "boolean", "string")
#: Functions of rules that give a value or NULL on any input.
PERMITTED = frozenset(
    """coalesce nullif ifnull nvl nvl2 if least greatest abs sign round floor ceil ceiling sqrt ln log10 exp power isnull isnotnull
    lower upper trim ltrim rtrim btrim length char_length octet_length substring substr left right concat concat_ws contains startswith endswith
    instr locate position replace translate reverse initcap lpad rpad split regexp_like regexp_replace regexp_extract get_json_object
    array get size cardinality array_contains array_size array_position arrays_overlap map_keys map_values map_contains_key sort_array array_distinct
    year month day dayofmonth dayofweek hour minute second date_trunc trunc datediff date_add date_sub current_date current_timestamp now
    unix_micros unix_millis unix_seconds md5 sha1 sha2 crc32 hash xxhash64 try_add try_subtract try_multiply try_divide try_mod try_element_at
    try_to_date try_to_timestamp try_to_number try_variant_get try_parse_json equal_null nanvl isnan""".split()
)
#: These take a pattern, which must be a literal so that it is known to be one when the rule is read.
_PATTERNS = {"split": 1, "regexp_like": 1, "regexp_replace": 1, "regexp_extract": 1}


def tolerant(spark: SparkSession, expr: str, unsigned: bool = False) -> str:
    """``expr`` with arithmetic and casts replaced by their tolerant forms.

    Spark parses the text; its tree is rebuilt from the leaves up, so only operators and the functions in ``_SAFE`` change.
    Any other function must be in ``PERMITTED``: one that can fail in a row, and an index in brackets, is a ValueError here.
    With ``unsigned`` a difference below zero is NULL, too, as counters cannot be negative on the way.
    """
    session = spark._jsparkSession
    parse = session.sessionState().sqlParser().parseExpression
    jvm = spark.sparkContext._jvm

    def refuse(what: str, instead: str = "") -> ValueError:
        return ValueError(f"{what} in {expr!r} can end the job{instead and '; use ' + instead}")

    def literal(node) -> bool:
        return node.getClass().getSimpleName() == "Literal"

    def build(node):
        kids = node.children()
        done = [build(kids.apply(i)) for i in range(kids.size())]
        if done:
            changed = jvm.java.util.ArrayList()
            for k in done:
                changed.add(k)
            node = node.withNewChildren(jvm.scala.jdk.javaapi.CollectionConverters.asScala(changed).toSeq())
        name = node.getClass().getSimpleName()
        if name == "UnresolvedExtractValue":
            raise refuse("an index in brackets", "get or try_element_at")
        if name == "RLike" and not literal(kids.apply(1)):
            raise refuse("a pattern that is not a literal")
        if name == "UnresolvedFunction":
            called = node.nameParts().mkString(".").lower()
            if called in _CASTS and kids.size() == 1:
                return parse(f"TRY_CAST({done[0].sql()} AS {called})")
            if called in _SAFE:
                return parse(f"{_SAFE[called]}({', '.join(k.sql() for k in done)})")
            if called not in PERMITTED:
                raise refuse(f"the function {called}")
            at = _PATTERNS.get(called)
            if at is not None and at < kids.size() and not literal(kids.apply(at)):
                raise refuse("a pattern that is not a literal")
        if name in _TRY:
            text = _TRY[name].format(*[k.sql() for k in done])
            if unsigned and name in ("Subtract", "UnaryMinus"):
                text = f"nullif(greatest({text}, -1), -1)"
            return parse(text)
        if name == "Cast" and node.sql().upper().startswith("CAST("):
            return parse("TRY_" + node.sql())
        return node

    return build(parse(expr)).sql()
