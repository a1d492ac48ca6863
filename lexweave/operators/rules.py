"""The rule layer over candidates of persons, organisations and addresses: expansion, scoring, supplements, aliases.

Candidates may come from a recogniser (a column array<struct<start,end,entity_type,confidence,has_fact>>); without one the rules
find what patterns can find. All of it is arrays of one document, so nothing is shuffled. Each step is a column of
its own: names of temporary columns begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import patterns as p
from lexweave.functions import vocabulary as v
from lexweave.functions.spans import column, find_spans, overlaps
from lexweave.functions.text import clean_entity, context_window, normal_key
from lexweave.operators.detect import NO_SPANS, span

# Accept and review thresholds, and the least confidence counted.
THRESHOLDS = {"PER": (0.78, 0.62, 0.42), "ORG": (0.77, 0.60, 0.48), "АДРЕС": (0.72, 0.55, 0.48)}
# Shapes of names and organisations with the confidence of a match.
_WORD = "(?:[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?|[А-ЯЁ]{2,40})"
_INITIALS = r"(?:[А-ЯЁ]\.\s?[А-ЯЁ]\.)"
_NAME_PART = rf"(?U)(?<![\w.]){_INITIALS}|\b{_WORD}(?!\w)"
_QUOTED = '(?:«[^»\\n]{2,80}»|"[^"]{2,80}")'
_SEQUENCE = r"(?:[А-ЯЁA-Z][А-Яа-яЁёA-Za-z0-9-]{1,40})(?:\s+[А-ЯЁA-Z][А-Яа-яЁёA-Za-z0-9-]{1,40}){0,5}"
ORG_PATTERNS = (
    (rf"(?iU)\b(?:{v.alternatives(v.ORG_LONG)})\s+(?:{_QUOTED}|{_SEQUENCE})", 0.96),
    (rf"(?iU)\b(?:{v.alternatives(v.ORG_SHORT)})\s+(?:{_QUOTED}|{_SEQUENCE})", 0.92),
    (r"(?iU)\b(?:Министерство|Департамент|Управление|Служба|Администрация|Комитет|Инспекция|Фонд|Банк)\s+[А-ЯЁA-Z][^,\n;:.]{2,80}", 0.82),
)
ADDRESS_PATTERNS = ((p.FULL_ADDRESS, 0.9), (p.POSTAL_CITY, 0.82), (p.CITY_STREET, 0.78), (p.PREPOSITIONAL, 0.72), (p.PREFIXED_ADDRESS, 0.86))
_TOKEN = r"[А-ЯЁA-Z][А-Яа-яЁёA-Za-z-]{1,40}|[А-ЯЁ]\.|[A-Z]\."
_WORDS = r"[А-ЯЁA-Zа-яёa-z][А-Яа-яЁёA-Za-z-]{0,40}"
_MAX_ADDRESS, _RIGHT_GAP, _LEFT_GAP = 220, 12, 40

_ROLE_OR_GENERIC = v.any_form(v.ROLES + v.BODIES + v.GENERIC + v.TABLE_HEADERS)
_PERSON_STOP = v.any_form(v.ROLES + v.BODIES + v.COURTS + v.CODES + v.GENERIC + v.TABLE_HEADERS)
_ORG_STOP = v.any_form(v.ROLES + v.BODIES + v.COURTS + v.CODES)
_TABLE = v.any_form(v.TABLE_HEADERS)
_KEYWORDS = v.any_form(v.ORG_KEYWORDS)
_PREFIX = v.any_form(v.ALIAS_PREFIXES + v.ROLES + v.BODIES + v.GENERIC + v.TABLE_HEADERS)
_PERSON_NEAR, _ADDRESS_NEAR = v.context(v.PERSON_CONTEXT), v.context(v.ADDRESS_CONTEXT)


def _like(text: Column, pattern: str | Column) -> Column:
    """Whether the pattern is found. Within lambdas rlike compiles its pattern for each value, regexp_instr once."""
    return F.regexp_instr(text, pattern if isinstance(pattern, Column) else F.lit(pattern)) > 0


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(clean_entity(text), F.lit(_WORDS), F.lit(0)), normal_key)


def _hits(words: Column, pattern: str) -> Column:
    return F.size(F.filter(words, lambda w: _like(w, pattern)))


def _verdict(score: Column, kind: str) -> Column:
    accept, review, _ = THRESHOLDS[kind]
    return F.when(score >= accept, "accept").when(score >= review, "review").otherwise("reject")


def _decision(kind: str, base: Column, steps) -> Column:
    """struct<verdict, score, reason, model_confidence, context_bonus, penalty>, from (condition, reason, bonus, penalty) in
    order; a rejection has a score in place of the bonus and None in place of the penalty."""
    out = None
    for condition, reason, bonus, penalty in reversed(steps):
        as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
        if penalty is None:
            made = F.struct(F.lit("reject").alias("verdict"), as_col(bonus).alias("score"), F.lit(reason).alias("reason"), F.lit(0.0).alias("model_confidence"), F.lit(0.0).alias("context_bonus"), F.lit(0.0).alias("penalty"))
        else:
            # Rounded far below the thresholds' own digits, so that 0.70 - 0.08 is 0.62.
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(base + as_col(bonus) - as_col(penalty), 9)))
            made = F.struct(_verdict(score, kind).alias("verdict"), score.alias("score"), F.lit(reason).alias("reason"), base.alias("model_confidence"), as_col(bonus).alias("context_bonus"), as_col(penalty).alias("penalty"))
        out = made if condition is None else F.when(condition, made).otherwise(out)
    return out


def decide_person(text: Column, start: Column, end: Column, original: Column, confidence: Column, has_fact: Column | None = None) -> Column:
    """Whether a person's name is one, by its parts and what stands around it."""
    fact = F.lit(False) if has_fact is None else has_fact
    parts = F.transform(F.regexp_extract_all(clean_entity(original), F.lit(_TOKEN), F.lit(0)), F.trim)
    near = _like(context_window(text, start, end), F.lit(_PERSON_NEAR))

    def of(z: Column) -> Column:
        t, words = z["parts"], z["words"]
        initial = lambda x: _like(x, r"(?iu)^[А-ЯЁ]\.(?:\s?[А-ЯЁ]\.)?$")
        shaped = F.forall(t, lambda x: initial(x) | (_like(x, "^[А-ЯЁA-Z][А-Яа-яЁёA-Za-z-]+$") & ((x != F.upper(x)) | (F.length(x) >= 4))))
        surname = lambda x: ~initial(x) & (F.length(x) >= 4) & _like(F.lower(x), f"(?:{'|'.join(v.SURNAME_ENDS)})$")
        patronymic = F.exists(t, lambda x: ~initial(x) & _like(F.lower(x), f"(?:{'|'.join(v.PATRONYMIC_ENDS)})$"))
        # Each is worked out once, whatever conditions ask for it.
        return _let(F.struct(
            F.size(t).alias("n"), F.size(words).alias("n_words"), shaped.alias("shaped"), F.size(F.filter(t, surname)).alias("surnames"), patronymic.alias("patronymic"), F.exists(t, initial).alias("initial"),
            _hits(words, _ROLE_OR_GENERIC).alias("generic"), _hits(words, _PERSON_STOP).alias("stop"), _hits(words, _TABLE).alias("table")), lambda y: decision(z, y))

    def decision(z: Column, y: Column) -> Column:
        context, base, shaped, surnames, patronymic = z["near"], z["base"], y["shaped"], y["surnames"], y["patronymic"]
        n, n_words, generic, stop, table = y["n"], y["n_words"], y["generic"], y["stop"], y["table"]
        plain = ~z["fact"] & ~context
        known = F.when(z["fact"], 0.16).otherwise(0.0)
        return _decision("PER", base, [
            (z["clean"] == "", "empty", 0.0, None),
            (n == 0, "no_name_tokens", 0.0, None),
            (~shaped, "non_name_token", 0.2, None),
            ((n_words > 0) & (stop == n_words), "generic_role_or_legal_term", 0.2, None),
            ((n_words > 0) & (generic == n_words), "generic_role_only_sequence", 0.05, None),
            ((table >= 2) & plain, "tabular_header_terms", 0.08, None),
            ((n >= 3) & (generic >= 2) & plain, "mostly_generic_three_part_sequence", 0.06, None),
            ((n >= 3) & ~patronymic & (surnames == 0) & plain, "non_person_three_part_sequence", 0.12, None),
            (n >= 3, "three_part_name", known + 0.2 + F.when(patronymic, 0.08).otherwise(0.0) + F.when(surnames > 0, 0.04).otherwise(0.0), 0.0),
            ((n == 2) & (generic >= 1) & plain, "generic_two_part_sequence", 0.08, None),
            ((n == 2) & y["initial"], "surname_with_initials", known + 0.22, 0.0),
            ((n == 2) & context, "two_part_name_with_context", known + 0.14, 0.0),
            ((n == 2) & (surnames > 0) & ((z["confidence"] >= 0.9) | z["fact"]), "borderline_two_part_name", known + 0.05, 0.0),
            (n == 2, "ambiguous_two_part_name", known, 0.08),
            (generic >= 1, "generic_single_token", 0.05, None),
            (context & ((surnames > 0) | (z["confidence"] >= 0.93) | z["fact"]), "single_token_with_context", known + 0.12, 0.0),
            (None, "ambiguous_single_token", known, 0.15),
        ])

    return _let(F.struct(parts.alias("parts"), _words(original).alias("words"), near.alias("near"), F.greatest(confidence, F.lit(THRESHOLDS["PER"][2])).alias("base"),
                         clean_entity(original).alias("clean"), confidence.alias("confidence"), F.coalesce(fact, F.lit(False)).alias("fact")), of)


def decide_org(original: Column, confidence: Column) -> Column:
    """Whether an organisation's name is one, by its legal form, keywords and what is distinctive about it."""
    def of(z: Column) -> Column:
        words, key = z["words"], z["key"]
        n = F.size(words)
        generic = _hits(words, _ROLE_OR_GENERIC)
        distinctive = generic < n
        several = F.size(F.split(z["clean"], r"(?U)\s+")) >= 2
        quoted = _like(z["clean"], '["«»]')
        has = lambda forms: _like(key, "|".join(f.lower() for f in forms))  # noqa: E731  anywhere, inside words as well
        return _decision("ORG", F.greatest(z["confidence"], F.lit(THRESHOLDS["ORG"][2])), [
            (z["clean"] == "", "empty", 0.0, None),
            (key.isin(*[f.lower() for f in v.ORG_SHORT]), "bare_org_form", 0.2, None),
            ((n > 0) & (generic == n), "generic_role_only_org", 0.05, None),
            (_hits(words, _ORG_STOP) > 0, "legal_stopword", 0.25, None),
            (has(v.ORG_SHORT) & distinctive & (quoted | several), "short_form_with_name", 0.24, 0.0),
            (has(v.ORG_SHORT), "short_form_without_distinctive_name", 0.08, None),
            (has(v.ORG_LONG) & ~distinctive, "long_form_without_distinctive_name", 0.08, None),
            (has(v.ORG_LONG), "long_form_org", 0.28, 0.0),
            ((_hits(words, _KEYWORDS) > 0) & several & distinctive, "keyword_org", 0.16, 0.0),
            ((z["confidence"] >= 0.9) & several & distinctive, "high_confidence_org", 0.05, 0.0),
            (None, "ambiguous_org", 0.0, 0.08),
        ])

    return _let(F.struct(_words(original).alias("words"), normal_key(clean_entity(original)).alias("key"), clean_entity(original).alias("clean"), confidence.alias("confidence")), of)


def decide_address(text: Column, start: Column, end: Column, original: Column, confidence: Column, source: Column) -> Column:
    """Whether an address is one, by its parts and what stands around it."""
    def of(z: Column) -> Column:
        acronym = (F.length(z["key"]) <= 3) & (z["clean"] == F.upper(z["clean"])) & (z["clean"] != F.lower(z["clean"]))
        return _decision("АДРЕС", F.greatest(z["confidence"], F.lit(THRESHOLDS["АДРЕС"][2])), [
            (z["clean"] == "", "empty", 0.0, None),
            (z["key"].isin(*v.COUNTRIES), "generic_country", 0.05, None),
            (acronym & ~z["near"], "short_upper_acronym", 0.1, None),
            (_like(z["clean"], f"(?U)(?:{p.STREET}|{p.HOUSE}|{p.POSTAL})"), "structural_address", 0.24, 0.0),
            (z["near"], "context_boost", 0.18, 0.0),
            ((z["source"] == "ner") & (z["confidence"] >= 0.88), "bare_loc_high_confidence", 0.0, 0.05),
            (None, "ambiguous_loc", 0.0, 0.15),
        ])

    return _let(F.struct(normal_key(clean_entity(original)).alias("key"), clean_entity(original).alias("clean"), _like(context_window(text, start, end), F.lit(_ADDRESS_NEAR)).alias("near"),
                         confidence.alias("confidence"), source.alias("source")), of)


_MATCH = "array<struct<start:int,longer:int,end:int,score:double>>"


def person_matches(text: str | Column) -> Column:
    """Two or three name words, or a name word and initials, in a row: array<struct<start, longer, end, score>>, by start, longest first.

    Leading words of a role (plaintiff, director...) are left out, but never the last one.
    """
    def of(z: Column) -> Column:
        t, x = z["tokens"], z["text"]
        gap = lambda a, b: F.substring(x, a["end"] + 1, b["start"] - a["end"])
        initials = lambda s: F.contains(s["original"], F.lit("."))
        role = lambda s: _like(normal_key(s["original"]), _PREFIX)
        made = lambda s, e, score: F.struct(s["start"].alias("start"), (-e["end"]).alias("longer"), e["end"].alias("end"), F.lit(score).alias("score"))

        def at(i: Column) -> Column:
            a, b, c = (F.try_element_at(t, i + k) for k in range(3))
            space_b = b.isNotNull() & _like(gap(a, b), r"(?U)^\s+$")
            space_c = c.isNotNull() & _like(gap(b, c), r"(?U)^\s+$")
            no_gap = b.isNotNull() & _like(gap(a, b), r"(?U)^\s*$")
            three = F.when(space_b & space_c & ~initials(a) & ~initials(b) & ~initials(c), F.when(role(a), F.when(role(b), made(c, c, 0.96)).otherwise(made(b, c, 0.96))).otherwise(made(a, c, 0.96)))
            with_initials = F.when(space_b & ~initials(a) & initials(b), made(a, b, 0.9)).when(no_gap & initials(a) & ~initials(b), made(a, b, 0.9))
            two = F.when(space_b & ~initials(a) & ~initials(b), F.when(role(a), made(b, b, 0.8)).otherwise(made(a, b, 0.8)))
            return F.filter(F.array(three, with_initials, two), lambda m: m.isNotNull())

        return F.when(F.size(t) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), at)))

    every = _let(F.struct(find_spans(text, _NAME_PART).alias("tokens"), column(text).alias("text")), of)
    empty = F.array().cast(_MATCH)
    # Of equal spans the surest.
    sorted_ = F.array_sort(F.array_distinct(F.coalesce(every, empty).cast(_MATCH)))
    return F.filter(sorted_, lambda m: ~F.exists(sorted_, lambda o: (o["start"] == m["start"]) & (o["end"] == m["end"]) & (o["score"] > m["score"])))


def _supplement(text: Column, matches: Column, kind: str, decide, taken: Column, ordinal: int, source: str = "rule") -> Column:
    """Matches in their order that stand free of `taken` and of each other and are accepted."""
    judged = F.filter(F.transform(matches, lambda m: m.withField("decision", decide(m))), lambda m: (m["decision"]["verdict"] == "accept") & ~overlaps(m["start"], m["end"], taken))
    made = F.transform(judged, lambda m, i: span(
        m["start"], m["end"], kind, clean_entity(F.substring(text, m["start"] + 1, m["end"] - m["start"])), source, F.greatest(m["score"], m["decision"]["score"]), F.lit(ordinal) + i))
    return F.aggregate(made.cast(NO_SPANS), F.array().cast(NO_SPANS), lambda acc, s: F.when(overlaps(s["start"], s["end"], acc), acc).otherwise(F.concat(acc, F.array(s))))


def _scored(text: str | Column, patterns: list[tuple[str, float]]) -> Column:
    def found(pattern: str, score: float) -> Column:
        return F.transform(find_spans(text, pattern), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longer"), s["end"].alias("end"), F.lit(score).alias("score")))

    return F.concat(*[found(*x) for x in patterns]).cast(_MATCH)


def grow_address(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: an address span grown over the parts of an address next to it, rightwards, then a postal code or region to its left."""
    parts = find_spans(text, p.ADDRESS_PART)

    def of(z: Column) -> Column:
        joined = lambda gap: _like(gap, r"^[ \t\r\n,;.]*$") & ~F.contains(gap, F.lit("\n\n")) & ~(_like(F.rtrim(gap), r"[.!?]\s*$") & ~F.trim(gap).isin(".", "!", "?"))
        right = F.aggregate(z["parts"], F.struct(z["end"].alias("end"), F.lit(False).alias("stop")), lambda acc, c: F.when(acc["stop"] | (c["start"] < acc["end"]), acc).otherwise(_let(
            F.substring(z["text"], acc["end"] + 1, c["start"] - acc["end"]), lambda gap: F.when(
                (acc["end"] - z["start"] < _MAX_ADDRESS) & (F.length(gap) <= _RIGHT_GAP) & joined(gap), F.struct(c["end"].alias("end"), F.lit(False).alias("stop"))
            ).otherwise(F.struct(acc["end"].alias("end"), F.lit(True).alias("stop"))))), lambda acc: acc["end"])
        before = F.substring(z["text"], F.greatest(z["start"] - _LEFT_GAP, F.lit(0)) + 1, F.least(z["start"], F.lit(_LEFT_GAP)))
        lead = lambda pattern: F.element_at(F.concat(F.array(F.lit(None).cast("struct<start:int,end:int,original:string>")), find_spans(before, pattern)), -1)
        base = F.greatest(z["start"] - _LEFT_GAP, F.lit(0))
        left = [F.when(c.isNotNull() & joined(F.substring(before, c["end"] + 1, F.length(before))), base + c["start"]) for c in (lead(f"(?U){p.POSTAL}"), lead(f"(?U){p.REGION}"))]
        return F.struct(F.least(z["start"], *left).alias("start"), right.alias("end"))

    return _let(F.struct(parts.alias("parts"), text.alias("text"), start.alias("start"), end.alias("end")), of)


def expand(text: Column, c: Column, people: Column, orgs: Column) -> Column:
    """A recogniser's candidate grown to the whole name, organisation or address it is a part of: struct<start, end, score>."""
    touching = lambda found: F.filter(found, lambda m: (m["start"] <= c["end"]) & (m["end"] >= c["start"]))
    cut = lambda s, e: F.substring(text, s + 1, e - s)
    own = F.struct(c["start"].alias("start"), c["end"].alias("end"), c["confidence"].alias("score"))

    def ranked(m: Column) -> Column:
        confidence = F.greatest(m["score"], c["confidence"])
        return _let(decide_person(text, m["start"], m["end"], cut(m["start"], m["end"]), confidence, c["has_fact"]), lambda d: F.struct(
            (d["verdict"] == "accept").cast("int").alias("accepted"), (d["verdict"] != "reject").cast("int").alias("reviewable"), d["score"].alias("value"),
            (m["end"] - m["start"]).alias("coverage"), confidence.alias("confidence"), (-m["start"]).alias("at"), m["end"].alias("end")))

    person = _let(F.array_max(F.transform(F.concat(F.array(own), F.transform(touching(people), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["score"].alias("score")))), ranked)),
                  lambda b: F.struct((-b["at"]).alias("start"), b["end"].alias("end"), b["confidence"].alias("score")))
    org = F.aggregate(touching(orgs), own, lambda best, m: F.when((m["end"] - m["start"] > best["end"] - best["start"]) | (F.greatest(m["score"], c["confidence"]) > best["score"]),
                      F.struct(m["start"].alias("start"), m["end"].alias("end"), F.greatest(m["score"], c["confidence"]).alias("score"))).otherwise(best))
    address = _let(grow_address(text, c["start"], c["end"]), lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), c["confidence"].alias("score")))
    return F.when(c["entity_type"] == "PER", person).when(c["entity_type"] == "ORG", org).otherwise(address)


_SIGNATURE = "struct<key:string,surname:string,initials:array<string>,rank:array<int>>"


def signature(original: Column, key: Column | None = None) -> Column:
    """struct<key, surname, initials, rank> of a person's mention: the longer and fuller, the higher the rank; null if it has no word."""
    def of(z: Column) -> Column:
        letters = lambda x: F.transform(F.filter(F.split(x, ""), lambda c: _like(c, "(?iu)[А-ЯЁ]")), lambda c: F.concat(F.upper(c), F.lit(".")))
        dotted = F.filter(z["t"], lambda x: F.contains(x, F.lit(".")))
        words = F.filter(z["t"], lambda x: ~F.contains(x, F.lit(".")))
        spelled = F.size(dotted) > 0
        surname = F.when(spelled & F.contains(F.element_at(z["t"], 1), F.lit(".")), F.try_element_at(words, F.lit(-1))).otherwise(F.try_element_at(words, F.lit(1)))
        initials = F.when(spelled, F.flatten(F.transform(dotted, letters))).otherwise(F.transform(F.slice(words, 2, 2), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))))
        return F.when(F.size(words) > 0, F.struct(
            F.coalesce(z["key"], normal_key(z["clean"])).alias("key"), surname.alias("surname"), initials.alias("initials"),
            F.array(F.size(z["t"]), F.size(initials), F.length(z["clean"])).alias("rank")))

    return _let(F.struct(F.regexp_extract_all(clean_entity(original), F.lit(_TOKEN), F.lit(0)).alias("t"), clean_entity(original).alias("clean"), (F.lit(None).cast("string") if key is None else key).alias("key")), of)


def alias_matches(text: Column, people: Column) -> Column:
    """Short mentions of known people: surname with initials either way round, after a word such as citizen, or alone near one.

    array<struct<start, longer, end, score, key>>; mentions equal to a person's full form are left out.
    """
    kind = "array<struct<start:int,longer:int,end:int,score:double,key:string>>"
    quote = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))

    def of(s: Column) -> Column:
        name = quote(s["surname"])
        initials = F.array_join(F.transform(s["initials"], quote), r"\s*")
        found = lambda pattern, score, skip=0: F.transform(find_spans(text, pattern), lambda m: F.struct(
            (m["end"] - F.length(s["surname"]) if skip else m["start"]).alias("start"), (-m["end"]).alias("longer"), m["end"].alias("end"), F.lit(score).alias("score"), s["key"].alias("key")))
        none = F.array().cast(kind)
        with_initials = F.when(F.size(s["initials"]) > 0, F.concat(
            found(F.concat(F.lit(r"(?U)\b"), name, F.lit(r"\s+"), initials, F.lit(r"(?=\s|$|[,;:])")), 0.9),
            found(F.concat(F.lit(r"(?U)(?<!\w)"), initials, F.lit(r"\s*"), name, F.lit(r"\b")), 0.9))).otherwise(none)
        prefixed = found(F.concat(F.lit(rf"(?U)\b(?iu:{v.alternatives(v.ALIAS_PREFIXES)})\.?\s+"), name, F.lit(r"\b")), 0.78, skip=1)
        bare = F.filter(found(F.concat(F.lit(r"(?U)\b"), name, F.lit(r"\b")), 0.76), lambda m: _like(context_window(text, m["start"], m["end"]), F.lit(_PERSON_NEAR)))
        return F.filter(F.concat(with_initials, prefixed, bare).cast(kind), lambda m: normal_key(clean_entity(F.substring(text, m["start"] + 1, m["end"] - m["start"]))) != s["key"])

    return F.coalesce(F.flatten(F.transform(people, of)), F.array().cast(kind))


def link_identities(spans: Column) -> Column:
    """Person spans with the identity key of the fullest mention of the same surname whose initials don't contradict theirs."""
    signed = F.transform(spans, lambda s: F.struct(s.alias("span"), F.when(s["entity_type"] == "PER", signature(s["original"], s["identity_key"])).alias("sig")))

    def link(z: Column, every: Column) -> Column:
        own = z["sig"]
        pool = F.reverse(F.array_sort(F.transform(F.filter(every, lambda o: o["sig"].isNotNull() & (normal_key(o["sig"]["surname"]) == normal_key(own["surname"]))), lambda o: F.struct(
            o["sig"]["rank"].alias("rank"), o["sig"]["key"].alias("key"), o["sig"]["initials"].alias("initials")))))

        def pick(pool: Column) -> Column:
            best = F.element_at(pool, 1)
            n = F.size(own["initials"])
            fitting = F.filter(pool, lambda c: F.slice(c["initials"], 1, F.greatest(n, F.lit(1))) == own["initials"])
            fuller = F.array_distinct(F.transform(F.filter(pool, lambda c: F.size(c["initials"]) > 0), lambda c: c["key"]))
            return F.when(best["rank"] <= own["rank"], own["key"]).when(n > 0, F.coalesce(F.try_element_at(fitting, F.lit(1))["key"], own["key"])).when(
                F.size(fuller) == 1, F.element_at(fuller, 1)).otherwise(best["key"])

        return F.when(own.isNull(), z["span"]).otherwise(z["span"].withField("identity_key", _let(pool, pick)))

    return _let(signed, lambda every: F.transform(every, lambda z: link(z, every)))


def best_of_equals(spans: Column) -> Column:
    """Of spans with equal type, place and text the one of the highest confidence, patterns before others."""
    key = lambda s: F.concat_ws("\u0001", s["entity_type"], s["start"], s["end"], normal_key(s["original"]))
    rank = lambda s: F.struct((s["source"] == "regex").cast("int"), s["confidence"], -s["ordinal"])
    return _let(F.coalesce(spans, F.array().cast(NO_SPANS)), lambda every: F.filter(every, lambda s: ~F.exists(every, lambda o: (key(o) == key(s)) & (rank(o) > rank(s)))))


NER = "array<struct<start:int,end:int,entity_type:string,confidence:double,has_fact:boolean>>"
_REVIEW = "array<struct<original:string,entity_type:string,start:int,end:int,source:string,confidence:double,verdict:string,score:double,reason:string,model_confidence:double,context_bonus:double,penalty:double>>"


def refine(documents: DataFrame, text: str = "text", ner: str | None = None) -> DataFrame:
    """Adds rule_spans (accepted), review_candidates and whitelist_skipped to documents.

    ner: a column of type NER with a recogniser's candidates (PER, ORG, LOC); without it the rules work on their own matches. Terms of
    the whitelist are skipped, never parts of them. Texts without Cyrillic capitals have none of all this.
    """
    x = F.col(text)
    some = _like(x, "[А-ЯЁ]")
    none = F.array().cast(NO_SPANS)
    given = F.coalesce(F.col(ner), F.array().cast(NER)) if ner else F.array().cast(NER)
    cut = lambda s, e: F.substring(x, s + 1, e - s)
    listed = lambda s: normal_key(clean_entity(s)).isin(*v.WHITELIST)
    out = documents.withColumns({
        "_people": F.when(some, person_matches(text)).otherwise(F.array().cast(_MATCH)),
        "_orgs": F.when(some, _scored(text, list(ORG_PATTERNS))).otherwise(F.array().cast(_MATCH)),
        "_places": F.when(some, _scored(text, list(ADDRESS_PATTERNS))).otherwise(F.array().cast(_MATCH)),
        "_given": given,
    })
    kind = lambda c: F.when(c["entity_type"] == "LOC", "АДРЕС").otherwise(c["entity_type"])

    def judged(c: Column, i: Column) -> Column:
        grown = expand(x, c, F.col("_people"), F.col("_orgs"))
        return _let(grown, lambda g: F.struct(
            c.alias("c"), g.alias("g"), i.alias("i"), kind(c).alias("kind"),
            F.when(c["entity_type"] == "PER", decide_person(x, g["start"], g["end"], cut(g["start"], g["end"]), g["score"], c["has_fact"]))
            .when(c["entity_type"] == "ORG", decide_org(cut(g["start"], g["end"]), g["score"]))
            .otherwise(decide_address(x, g["start"], g["end"], cut(g["start"], g["end"]), g["score"], F.lit("ner"))).alias("d")))

    if ner:
        # Country names and bare acronyms that no address word stands near aren't places.
        noise = lambda c: (c["entity_type"] == "LOC") & _let(clean_entity(cut(c["start"], c["end"])), lambda s: F.lower(s).isin(*v.COUNTRIES) | (
            (F.length(s) <= 3) & (s == F.upper(s)) & (s != F.lower(s)) & ~_like(context_window(x, c["start"], c["end"]), F.lit(_ADDRESS_NEAR))))
        out = out.withColumn("_given", F.filter("_given", lambda c: c["entity_type"].isin("PER", "ORG", "LOC") & ~noise(c)))
        out = out.withColumn("_judged", F.transform(F.filter("_given", lambda c: ~listed(cut(c["start"], c["end"]))), judged))
        accepted = F.transform(F.filter("_judged", lambda j: j["d"]["verdict"] == "accept"), lambda j: span(
            j["g"]["start"], j["g"]["end"], j["kind"], clean_entity(cut(j["g"]["start"], j["g"]["end"])), "ner", F.greatest(j["g"]["score"], j["d"]["score"]), j["i"]))
        review = F.transform(F.filter("_judged", lambda j: j["d"]["verdict"] == "review"), lambda j: F.struct(
            clean_entity(cut(j["g"]["start"], j["g"]["end"])).alias("original"), j["kind"].alias("entity_type"), j["g"]["start"].alias("start"), j["g"]["end"].alias("end"), F.lit("ner").alias("source"),
            j["g"]["score"].alias("confidence"), *[j["d"][f].alias(f) for f in ("verdict", "score", "reason", "model_confidence", "context_bonus", "penalty")]))
        skipped = F.transform(F.filter("_given", lambda c: listed(cut(c["start"], c["end"]))), lambda c: clean_entity(cut(c["start"], c["end"])))
    else:
        accepted, review, skipped = none, F.array().cast(_REVIEW), F.array().cast("array<string>")
    out = out.withColumns({"_accepted": accepted.cast(NO_SPANS), "review_candidates": review.cast(_REVIEW), "_skipped": skipped})
    org = lambda m: decide_org(cut(m["start"], m["end"]), m["score"])
    person = lambda m: decide_person(x, m["start"], m["end"], cut(m["start"], m["end"]), m["score"])
    place = lambda m: decide_address(x, m["start"], m["end"], cut(m["start"], m["end"]), m["score"], F.lit("rule"))
    out = out.withColumn("_found_orgs", _supplement(x, F.col("_orgs"), "ORG", org, F.col("_accepted"), 10_000))
    out = out.withColumn("_found_people", _supplement(x, F.col("_people"), "PER", person, F.concat("_accepted", "_found_orgs"), 20_000))
    out = out.withColumn("_found_places", _supplement(x, F.col("_places"), "АДРЕС", place, F.concat("_accepted", "_found_orgs", "_found_people"), 30_000))
    found = F.concat("_found_orgs", "_found_people", "_found_places")
    out = out.withColumns({
        "whitelist_skipped": F.array_distinct(F.concat("_skipped", F.transform(F.filter(found, lambda s: listed(s["original"])), lambda s: s["original"]))),
        "_rule": F.concat("_accepted", F.filter(found, lambda s: ~listed(s["original"]))),
    })
    # People known so far; of equal keys the fullest.
    people = F.filter(F.array_distinct(F.transform(F.filter("_rule", lambda s: s["entity_type"] == "PER"), lambda s: signature(s["original"]))), lambda s: s.isNotNull())
    out = out.withColumn("_known", people)
    out = out.withColumn("_aliases", F.when(F.size("_known") > 0, alias_matches(x, F.col("_known"))))
    alias = F.aggregate(
        F.coalesce("_aliases", F.array().cast("array<struct<start:int,longer:int,end:int,score:double,key:string>>")), F.array().cast(NO_SPANS),
        lambda acc, m: F.when(overlaps(m["start"], m["end"], acc) | overlaps(m["start"], m["end"], F.col("_rule")), acc).otherwise(_let(person(m), lambda d: F.when(
            d["verdict"] == "accept", F.concat(acc, F.array(span(m["start"], m["end"], "PER", clean_entity(cut(m["start"], m["end"])), "alias", F.greatest(m["score"], d["score"]), F.size(acc) + 40_000, m["key"]))))
            .otherwise(acc))))
    out = out.withColumn("_all", F.concat("_rule", alias))
    return out.withColumn("rule_spans", best_of_equals(link_identities(F.col("_all")))).drop(
        "_people", "_orgs", "_places", "_given", "_judged", "_accepted", "_skipped", "_found_orgs", "_found_people", "_found_places", "_rule", "_known", "_aliases", "_all")
