"""The recogniser: decoding against all label sequences, and quality on names that it has never seen."""

import random
from itertools import product

import numpy as np

from lexweave.functions import vocabulary as v
from lexweave.operators import anonymize, evaluate, recognize

LABELLED = "text string, spans array<struct<start:int,end:int,entity_type:string>>"
ENDS = ["ов", "ев", "ин", "енко", "ский", "ук"]
STEMS = "Бор Вол Гор Дем Ефим Жар Зуб Климат Лоб Мар Ник Овс Пан Рог Сав Тим Уш Фад Хар Чер Шап Яш".split()
FIRMS = "Вектор Гранит Маяк Рассвет Прогресс Восток Альянс Сатурн Спектр Титан Родник Импульс Каскад Эталон Феникс Орион".split()
TOWNS = "Омск Томск Казань Пермь Самара Уфа Тверь Псков Курск Орёл Брянск Калуга Рязань Тула Чита Сочи".split()
TEMPLATES = [
    "{P} заключил договор с {O} в городе {L}.", "Истец {P} просит взыскать долг с {O}.", "Директор {O} {P} прибыл из города {L} вчера.", "Суд установил, что {P} проживает в городе {L}.", "По делу выступил {P}, представитель {O}.",
    "Стороны согласовали сроки, порядок и цену поставки.", "Договор подписан 5 мая 2020 года.", "В город {L} приехал {P} и осмотрел товар.", "{O} обязуется поставить зерно.", "Между {O} и {O} возник спор.", "Товар принят. {P} расписался в акте. Претензий нет.",
]


def corpus(n, seed, half):
    """Sentences with their spans; each half has names of its own."""
    rng = random.Random(seed)
    some = lambda words: rng.choice([w for i, w in enumerate(words) if i % 2 == half])

    def name(kind):
        if kind == "P":
            family = some(STEMS) + rng.choice(ENDS)
            given, father = some(v.GIVEN_NAMES[:20]), some(STEMS) + "ович"
            return rng.choice([f"{family} {given} {father}", f"{family} {given[0]}.{father[0]}.", f"{given} {family}", f"{given[0]}.{father[0]}. {family}"])
        if kind == "O":
            quote = rng.choice(["«»", '""'])
            return f"{rng.choice(['ООО', 'АО', 'ПАО', 'ЗАО'])} {quote[0]}{some(FIRMS)}{rng.choice(['', ' ' + some(FIRMS)])}{quote[1]}"
        return some(TOWNS)

    out = []
    for _ in range(n):
        text, spans = "", []
        for piece in rng.choice(TEMPLATES).replace("{", "|{").replace("}", "}|").split("|"):
            if piece in ("{P}", "{O}", "{L}"):
                said = name(piece[1])
                spans.append((len(text), len(text) + len(said), {"P": "PER", "O": "ORG", "L": "АДРЕС"}[piece[1]]))
                text += said
            else:
                text += piece
        out.append((text, spans))
    return out


def test_decoding_finds_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    tagger = recognize.Tagger(("A", "B"))
    tagger.moves[:] = rng.normal(size=tagger.moves.shape)
    sizes = [1, 4, 2, 3]
    scores = rng.normal(size=(sum(sizes), len(tagger.labels))).astype(np.float32)
    sentence, place = np.repeat(np.arange(4), sizes), np.concatenate([np.arange(n) for n in sizes])
    got, at = tagger.decode(scores, sentence, place), 0
    for n in sizes:
        def value(labels):
            if any(tagger.barred[a, b] for a, b in zip((-1, *labels), labels)):
                return -np.inf
            return sum(tagger.moves[a, b] for a, b in zip((-1, *labels), labels)) + sum(scores[at + i, x] for i, x in enumerate(labels))

        assert tuple(got[at : at + n]) == max(product(range(len(tagger.labels)), repeat=n), key=value)
        at += n
    assert len(tagger.decode(scores[:0], sentence[:0], place[:0])) == 0


def test_quality_on_unseen_names(spark):
    """The gates for people and organisations (0.93 and 0.90) and for addresses (0.85 and 0.80), on an own corpus."""
    tagger = recognize.fit(spark.createDataFrame(corpus(900, 1, 0), LABELLED).repartition(4))
    test = [(i, t, s) for i, (t, s) in enumerate(corpus(500, 2, 1))]
    df = spark.createDataFrame(test, "doc_id long, " + LABELLED).repartition(4)
    out = recognize.recognize(df.withColumnRenamed("spans", "gold"), tagger)
    rows = lambda c: out.selectExpr("doc_id", f"inline({c})").select("doc_id", "entity_type", "start", "end")
    rates = {r["entity_type"]: r for r in evaluate.span_precision_recall(rows("gold"), rows("ner"), exact=True).collect()}
    print({k: (round(r["precision"], 3), round(r["recall"], 3)) for k, r in rates.items()})
    for kind, precision, recall in (("PER", 0.93, 0.9), ("ORG", 0.93, 0.9), ("АДРЕС", 0.85, 0.8)):
        assert rates[kind]["precision"] >= precision and rates[kind]["recall"] >= recall
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "слово " * 20_000)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["ner"]) for r in recognize.recognize(odd, tagger).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    # What is recognised feeds the rules: names that no dictionary has are replaced.
    text = "Между АО «Родник» и ООО «Эталон» возник спор. Жарук Кирилл Тимович расписался в акте."
    said = recognize.recognize(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger)
    hidden = anonymize.anonymize(said, dictionaries=False, ner="ner").first()["anonymized_text"]
    assert not any(w in hidden for w in ("Родник", "Эталон", "Жарук", "Кирилл"))


def test_same_sample_gives_the_same_tagger(spark):
    df = spark.createDataFrame(corpus(60, 3, 0) + [(None, []), ("x", None)], LABELLED)
    a, b = recognize.fit(df.repartition(3), epochs=2), recognize.fit(df.repartition(1), epochs=2)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
