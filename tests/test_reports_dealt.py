"""Reports of one small file are many tasks, and patterns that are left untried would have found nothing."""

import random

from pyspark.sql import functions as F

from sitecast.functions import text as T
from sitecast.operators import extract as X
from sitecast.plans import registry_queries as Q

WORDS = ["12", "3,5", "0,4", "kg", "kg rocznie", "wędkarzy", "wedkarz", "Całkowity odłów", "odłowy wyniosły", "odłów wyniósł", "roczny odłów", "rocznie", "złowionych ryb", "odłów na 1 wędkującego", "na 1 wędkarza", "dziennego odłowu", "odłów dzienny", "dzienny odłów", "łowili średnio", "ryb na dzień", "dziennie przypadało średnio", "w jednym dniu", "ryb dziennie", "dni", "dnia", "karp", "karpia", "karpiowate", "lin", "lina", "malin", "alin", "sum", "o średniej masie", "średnio", "kilogramowy", "-kilogramowy", "udziałem", "stanowił", "(", "%", ",", ".", " – "]


def test_a_small_file_is_many_tasks(spark):
    assert Q._reports(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_what_is_not_tried_would_not_match(spark):
    rng = random.Random(7)
    bodies = [rng.choice((" ", "")).join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    plain = lambda patterns: T.number(F.coalesce(*(F.when(F.regexp_extract("body", p, 1) != "", F.regexp_extract("body", p, 1)) for p in patterns)))
    columns, hits = [], 0
    for c, patterns in X.FIGURES.items():
        u = [f"(?U){p}" for p in patterns]
        columns += [(T.number(T.first_of(F.col("body"), u, [(x,) for x in X.NEEDED[c]])), plain(u), c)]
    for name, guard in (("karp", "(?!iowat)"), ("lin", ""), ("sum", "")):
        word = rf"(?<![{X.LETTERS}]){name}{guard}"
        weight = r"(?:\s+o\s+średni\w+\s+(?:masie|wadze)\s*\d+(?:,\d+)?\s*kg)?"
        columns += [(X._share(F.col("body"), name), plain([rf"(?U){word}\w*(?![{X.LETTERS}]){weight}(?:\s*\(|\s+stanowi\w*|\s*[–-]|\s+)\s*({X.PLAIN})\s*%", rf"(?U)udzia[łl]em\s*\(?({X.DECIMAL})\s*%\)?[^.]{{0,45}}?{word}"]), f"{name} share")]
        columns += [(X._mean_weight(F.col("body"), name), plain([rf"(?U)\b{name}{guard}\w*\s+o\s+średni\w+\s+(?:masie|wadze)\s*({X.PLAIN})\s*kg", rf"(?U)średnio\s*({X.PLAIN})-?\s*kilogramow\w*\s+{name}"]), f"{name} weight")]
    for r in rows.select("body", *(F.struct(got.alias("got"), want.alias("want")).alias(c) for got, want, c in columns)).collect():
        for _, _, c in columns:
            assert r[c].got == r[c].want, (c, r.body)
            hits += r[c].want is not None
    assert hits > 300
