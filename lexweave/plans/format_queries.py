"""Every fixed format of both profiles over rows written from `customer`: the SQL knows each value and where it stands.

A template says what precedes a value, the value, and one that is nearly right and must not be found; all are SQL expressions
of the customer's number k, which both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.patterns import PATTERNS
from lexweave.functions.spans import find_spans
from lexweave.plans.queries import query
from lexweave.session import table

_AFTER = " — и далее"


def _digits(n: int, salt: int = 0) -> str:
    """n digits that change with k."""
    return f"substr(concat(lpad(concat('', (k * 7919 + {salt * 131 + 7}) % 10000000000), 10, '3'), lpad(concat('', (k * 104729 + {salt}) % 10000000000), 10, '5')), {1 + salt % 3}, {n})"


def _all(*parts: str) -> str:
    """Parts one after another; what isn't a call or a number is said as it is."""
    return "concat(" + ", ".join(p if "(" in p and "k" in p and ")" in p else f"'{p}'" for p in parts) + ")"


_D = _digits
_NAME = "substr('АлеевБоринВолинГорин', 1 + 5 * (k % 4), 5)"
_DAY, _MONTH, _YEAR = "lpad(concat('', 1 + k % 28), 2, '0')", "lpad(concat('', 1 + k % 12), 2, '0')", "concat('', 1950 + k % 70)"
_DATE = _all(_DAY, ".", _MONTH, ".", _YEAR)
_CASE, _INITIALS = _all("А40-", "concat('', k)", "/2021"), _all(_NAME, " И.П.")
_PLATE = _all("А", _D(3), "ВС77")
_COMMON = {
    "account": (_all("4", _D(17), "21"), _all("4", _D(17), "213")), "card": (_all("4", _D(3), " ", _D(4, 1), "-", _D(4, 2), " ", _D(4)), _all("4", _D(3), "  ", _D(4, 1), "-", _D(4, 2), " ", _D(4))),
    "bik": (_all("0", _D(8)), _all("1", _D(8))), "vin": (_all("XTAR", _D(13)), _all("XTOR", _D(13))), "passport": (_all("45", " ", _D(2), " ", _D(6, 1)), _all("45", "  ", _D(2), " ", _D(6, 1))),
    "trailer": (_all("АВ", _D(4), " 77"), _all("АЯ", _D(4), " 77")), "motorcycle": (_all(_D(4), "АВ", "177"), _all(_D(4), "АЖ", "177")),
    "verbal": (_all("concat('', 1 + k % 28)", " марта ", "concat('', 1950 + k % 70)", " года"), _all("concat('', 40 + k % 28)", " мартабря ", "concat('', 1950 + k % 70)", " года")),
    "date": (_DATE, _all(_DAY, ".13.", _YEAR)), "case": (_CASE, _all("А40", "concat('', k)", "/2021")), "initials": (_INITIALS, _all("lower(concat('', " + _NAME + "))", " И.П.")),
    "phone": (_all("+7 (9", _D(2), ") ", _D(3, 1), "-", _D(2), "-", _D(2, 1)), _all("+6 (9", _D(2), ") ", _D(3, 1), "-", _D(2), "-", _D(2, 1))),
    "email": (_all("user", "concat('', k)", "@mail", "concat('', k % 10)", ".ru"), _all("user", "concat('', k)", "@mail", "concat('', k % 10)")), "car": (_PLATE, _all("А", _D(3), "ЯС77")),
}
#: What is found of each pattern in order: value, near miss.
_TEMPLATES = {
    "rules": [
        _COMMON["account"], _COMMON["card"], _COMMON["bik"], _COMMON["vin"], _COMMON["passport"], (_all("ОГРН: ", "1", _D(12)), _all("ОГРНИП ", "1", _D(12))), (_all("инн ", "7", _D(9)), _all("инн ", "7", _D(8))),
        (_all(_D(3), "-", _D(3, 1), "-", _D(3, 2), " ", _D(2)), _all(_D(3), "/", _D(3, 1), "-", _D(3, 2), " ", _D(2))), _COMMON["trailer"], _COMMON["motorcycle"], _COMMON["verbal"], _COMMON["date"], _COMMON["case"],
        _COMMON["initials"], _COMMON["phone"], _COMMON["email"], (_all("дата рождения: ", _DATE), _all("дата смерти: ", _DATE)), (_all("ХХХ ", _D(10)), _all("ХХ ", _D(10))), (_all("77", " УВ ", _D(6)), _all("77", " УВ ", _D(5))), _COMMON["car"],
        (_all("ул. Мира, д. ", "concat('', k)"), _all("ул. мира, ", "concat('', k)")), (_all("адрес: ул. Зелёная, д. ", "concat('', k)", ", кв. 5"), _all("адрес: ", "concat('', k)")),
        (_all("644", _D(3), ", г. Омск"), _all("644", _D(3), ", Омск")), (_all("г. ", _NAME, ", ул. Мира"), _all("г. ", _NAME, ", мира")), (_all("на улице ", _NAME), _all("у улицы ", _NAME)),
        (_all("МКАД, ", "concat('', k % 100)", " км"), _all("МКОД, ", "concat('', k % 100)", " км")),
    ],
    "tokens": [
        _COMMON["account"], _COMMON["card"], _COMMON["bik"], _COMMON["vin"], (_all(_D(3), "-", _D(3, 1), "-", _D(3, 2), " ", _D(2)), _all(_D(3), " ", _D(3, 1), " ", _D(3, 2), " ", _D(2))), (_all("77", _D(8)), _all("77", _D(9))),
        _COMMON["phone"], _COMMON["passport"], (_all("ящик_", "concat('', k)", "@почта.рф"), _all("ящик_", "concat('', k)", "@почта")), _COMMON["car"], _COMMON["trailer"], _COMMON["motorcycle"],
        (_all("ХХХ ", _D(10)), _all("XXX ", _D(10))), (_all("77", " УВ ", _D(6)), _all("77", " UV ", _D(6))), _COMMON["date"], _COMMON["verbal"], (_all("г. ", _NAME), _all("гор ", _NAME)), _COMMON["case"], _COMMON["initials"],
    ],
}


def _found(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """The spans of each pattern in its own two rows of each customer."""
    specs, templates = PATTERNS[profile], _TEMPLATES[profile]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    texts = rows.select("k", *[F.expr(f"concat('Запись ', concat('', k), ': ', {value}, '{_AFTER}')").alias(f"t{n}_{w}") for n, pair in enumerate(templates) for w, value in enumerate(pair)])
    spans = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(spec.entity_type).alias("entity_type"), F.lit(w == 0).alias("right"), find_spans(f"t{n}_{w}", spec.pattern).alias("spans")) for n, spec in enumerate(specs) for w in (0, 1)])
    each = texts.select("k", F.inline(spans)).select("k", "pattern", "entity_type", "right", F.explode("spans").alias("s"))
    return each.select(F.col("k").alias("id"), F.col("pattern").cast("long").alias("pattern"), "entity_type", "right", F.col("s.start").cast("long").alias("start_at"), "s.original")


def _expected(profile: str) -> str:
    one = "SELECT k AS id, CAST({n} AS BIGINT) AS pattern, '{kind}' AS entity_type, true AS \"right\", CAST(length(concat('Запись ', k, ': ')) AS BIGINT) AS start_at, {value} AS original FROM c"
    rows = (one.format(n=n, kind=spec.entity_type, value=value) for n, (spec, (value, _)) in enumerate(zip(PATTERNS[profile], _TEMPLATES[profile])))
    return "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) " + " UNION ALL ".join(rows)


@query(_expected("rules"))
def formats_of_rules(spark, sf_dir):
    """All 26 patterns of the profile rules, each over a value and a near miss for every customer."""
    return _found(spark, sf_dir, "rules")


@query(_expected("tokens"))
def formats_of_tokens(spark, sf_dir):
    """All 19 patterns of the profile tokens, each over a value and a near miss for every customer."""
    return _found(spark, sf_dir, "tokens")
