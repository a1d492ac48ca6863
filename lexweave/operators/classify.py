"""Topic classification and the legal analysis that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAW = "struct<title:string,article:string,text:string>"
PRACTICE = "struct<`case`:string,court:string,outcome:string>"

# Stems that tell a topic; the first topic that has one in the text is taken.
TOPICS = (
    ("labor", ("труд", "увольнен", "работник", "зарплат")),
    ("civil", ("договор", "сделк", "поставк", "аренд")),
    ("tax", ("налог", "ндс", "прибыл", "ифнс")),
)
# What is said about each topic.
ANALYSES = (
    ("labor", "Документ содержит признаки трудового спора. Проверьте основания увольнения и соблюдение процедур ТК РФ.",
     [("Трудовой кодекс РФ", "ст. 81", "Основания расторжения трудового договора по инициативе работодателя."), ("Трудовой кодекс РФ", "ст. 140", "Сроки расчета с работником при увольнении.")],
     [("Спор об увольнении", "Суд общей юрисдикции", "Проверяется соблюдение процедуры и доказанность основания увольнения.")],
     "1. Проверьте процедуру увольнения.\n2. Сверьте сроки расчета.\n3. Соберите доказательства дисциплинарного проступка либо основания спора."),
    ("civil", "Документ относится к гражданско-правовым отношениям. Проверьте предмет договора, сроки и порядок ответственности сторон.",
     [("Гражданский кодекс РФ", "ст. 450", "Основания изменения и расторжения договора."), ("Гражданский кодекс РФ", "ст. 393", "Возмещение убытков при неисполнении обязательства.")],
     [("Спор о расторжении договора", "Арбитражный суд", "Исследуется существенность нарушения условий договора.")],
     "1. Проверьте существенные условия договора.\n2. Оцените основания расторжения или взыскания убытков.\n3. Сопоставьте фактические обстоятельства с условиями сделки."),
    ("tax", "Документ затрагивает налоговые правоотношения. Требуется сверка с актуальной редакцией НК РФ и фактами хозяйственной операции.",
     [("Налоговый кодекс РФ", "ст. 75", "Пени за несвоевременную уплату налога."), ("Налоговый кодекс РФ", "гл. 25", "Налог на прибыль организаций.")],
     [("Налоговый спор", "Арбитражный суд", "Оцениваются документы, реальность операции и добросовестность налогоплательщика.")],
     "1. Сверьте спорную операцию с подтверждающими документами.\n2. Проверьте применимую редакцию НК РФ.\n3. Подготовьте позицию по реальности операции и налоговой выгоде."),
    ("general", "Система работает в демо-режиме. Для реального анализа подключите внешний источник или локальную LLM.",
     [("Демо-режим", "—", "Подключите реальный источник анализа для актуальных норм и практики.")],
     [("Данные недоступны", "—", "В демо-режиме судебная практика ограничена шаблонным ответом.")],
     "Подключите внешний источник или локальную LLM для production-анализа."),
)
# Articles that fit road-accident documents, whatever is asked.
ROAD_LAWS = (("Ст. 1079 ГК РФ", "Ответственность за вред, причинённый источником повышенной опасности."), ("Ст. 12.24 КоАП РФ", "Нарушение правил дорожного движения, повлёкшее лёгкий или средний вред здоровью."),
             ("Ст. 264 УК РФ", "Нарушение правил дорожного движения, повлёкшее тяжкий вред здоровью."), ("40-ФЗ «Об ОСАГО»", "Порядок возмещения вреда при использовании транспортных средств."),
             ("Постановление Пленума ВС РФ № 25", "Разъяснения о возмещении убытков."))


def topic(text: Column, topics=TOPICS, default: str = "general") -> Column:
    """The first topic one of whose stems is in the text, lower-cased."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for name, stems in reversed(topics):
        out = F.when(low.rlike("|".join(stems)), name).otherwise(out)
    return out


def analyses(spark: SparkSession) -> DataFrame:
    """The four analyses as a table: topic, summary, relevant_laws, court_practice, recommendations."""
    return spark.createDataFrame(list(ANALYSES), f"topic string, summary string, relevant_laws array<{LAW}>, court_practice array<{PRACTICE}>, recommendations string")


def analyze(documents: DataFrame, text: str = "anonymized_text") -> DataFrame:
    """documents with topic, summary, relevant_laws, court_practice, recommendations."""
    return documents.withColumn("topic", topic(F.col(text))).join(F.broadcast(analyses(documents.sparkSession)), "topic", "left")


def road_laws(queries: DataFrame) -> DataFrame:
    """Five rows for each row of queries: title, snippet."""
    hits = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(s).alias("snippet")) for t, s in ROAD_LAWS])
    return queries.select("*", F.explode(hits).alias("_hit")).select(*queries.columns, "_hit.*")


def _first(item: Column, *fields: str) -> Column:
    return F.coalesce(*[F.nullif(item[f], F.lit("")) for f in fields], F.lit(""))


def normalize_laws(payload: Column) -> Column:
    """Laws of a search reply (JSON): documents first, then result.laws; texts of 300 characters, eight at most."""
    doc = "struct<title:string,name:string,article:string,section:string,snippet:string,text:string>"
    law = "struct<title:string,article:string,description:string,text:string>"
    raw = F.from_json(payload, f"struct<documents:array<{doc}>,result:struct<laws:array<{law}>>>")
    cut = lambda c: F.substring(c, 1, 300)
    made = lambda t, a, x: F.struct(t.alias("title"), a.alias("article"), cut(x).alias("text"))
    none = F.array().cast(f"array<{LAW}>")
    documents = F.transform(raw["documents"], lambda d: made(_first(d, "title", "name"), _first(d, "article", "section"), _first(d, "snippet", "text")))
    laws = F.transform(raw["result"]["laws"], lambda d: made(_first(d, "title"), _first(d, "article"), _first(d, "description", "text")))
    return F.slice(F.concat(F.coalesce(documents, none), F.coalesce(laws, none)), 1, 8)


def normalize_practice(payload: Column) -> Column:
    """Court practice of a search reply (JSON): cases first, then result.practice; five at most."""
    item = "struct<number:string,`case`:string,court:string,outcome:string,result:string>"
    raw = F.from_json(payload, f"struct<cases:array<{item}>,result:struct<practice:array<{item}>>>")
    none = F.array().cast(f"array<{item}>")
    both = F.concat(F.coalesce(raw["cases"], none), F.coalesce(raw["result"]["practice"], none))
    return F.slice(F.transform(both, lambda d: F.struct(_first(d, "number", "case").alias("case"), _first(d, "court").alias("court"), _first(d, "outcome", "result").alias("outcome"))), 1, 5)


def search_summary(laws: Column, practice: Column) -> Column:
    """A sentence on what a search has found."""
    titles = F.array_join(F.filter(F.transform(F.slice(laws, 1, 3), lambda x: x["title"]), lambda t: t != ""), ", ")
    return F.when(F.size(laws) == 0, "Релевантные нормы не найдены. Уточните запрос.").otherwise(F.concat(
        F.lit("Найдено "), F.size(laws), F.lit(" релевантных нормативных акта(ов). Основные: "), F.when(titles == "", "без уточнения").otherwise(titles),
        F.lit(". Судебная практика: "), F.size(practice), F.lit(" дел(а).")))


def search_recommendations(laws: Column) -> Column:
    return F.when(F.size(laws) == 0, "Рекомендуется уточнить юридическую квалификацию вопроса.").otherwise(
        "На основании найденных норм рекомендуется:\n1. Проверить актуальность редакций указанных нормативных актов.\n"
        "2. Уточнить применимость норм к конкретным обстоятельствам дела.\n3. Сопоставить найденные нормы с судебной практикой и доказательствами по делу.")


def parse_llm_analysis(reply: Column) -> Column:
    """struct<summary, relevant_laws, court_practice, recommendations, parsed> of a model's reply, a JSON object, possibly fenced.

    Risks are added to the recommendations; a reply that can't be read gives a note and its first 500 characters.
    """
    body = F.regexp_extract(F.regexp_replace(reply, "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    raw = F.from_json(body, f"struct<summary:string,relevant_laws:array<{LAW}>,court_practice:array<{PRACTICE}>,recommendations:string,risks:string>")
    ok = (body != "") & F.from_json(body, "map<string,string>").isNotNull()
    risks, advice = F.trim(F.coalesce(raw["risks"], F.lit(""))), F.coalesce(raw["recommendations"], F.lit(""))
    full = F.when(risks == "", advice).when(advice == "", F.concat(F.lit("РИСКИ: "), risks)).otherwise(F.concat(advice, F.lit("\n\nРИСКИ: "), risks))
    return F.when(ok, F.struct(
        F.coalesce(raw["summary"], F.lit("")).alias("summary"), F.coalesce(raw["relevant_laws"], F.array().cast(f"array<{LAW}>")).alias("relevant_laws"),
        F.coalesce(raw["court_practice"], F.array().cast(f"array<{PRACTICE}>")).alias("court_practice"), full.alias("recommendations"), F.lit(True).alias("parsed"),
    )).otherwise(F.struct(
        F.lit("LLM вернула нечитаемый ответ. Повторите запрос.").alias("summary"), F.array().cast(f"array<{LAW}>").alias("relevant_laws"), F.array().cast(f"array<{PRACTICE}>").alias("court_practice"),
        F.substring(reply, 1, 500).alias("recommendations"), F.lit(False).alias("parsed")))


def prompt(text: Column, limit: int = 8000) -> Column:
    """What of a text goes into a model's prompt."""
    return F.substring(text, 1, limit)


def analysis_mode(mode: str | None, api_key: str | None = None, llm_url: str | None = None) -> str:
    """The analyser to use: demo, kp or llm as said; auto takes kp with a real key, llm with an address, else demo."""
    asked = (mode or "auto").strip().lower()
    if asked in ("demo", "kp", "llm"):
        return asked
    if api_key and api_key != "DEMO_KEY" and len(api_key) > 10:
        return "kp"
    return "llm" if (llm_url or "").strip() else "demo"
