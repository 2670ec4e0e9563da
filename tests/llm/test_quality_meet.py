"""Groups' estimates give the same verdicts broadcast or met over salted keys."""

import random
from dataclasses import replace

from sitecast.llm import quality


def test_salted_and_broadcast_estimates_agree(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta river lake stone bridge cloud meadow forest winter summer evening".split()
    rows = [(i, " ".join(rng.choice(words) + rng.choice(("", ".", "!")) for _ in range(rng.randint(60, 120))), rng.choice(("en", "de", None)), rng.choice(("s", "t"))) for i in range(150)]
    rows += [(500, "#$% &&& <<< " * 60, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = [sorted(tuple(r) for r in quality.judge(docs, p).select("doc_id", "kept").collect()) for p in (quality.QualityParams(), replace(quality.QualityParams(), small=0))]
    assert found[0] == found[1] and len(found[0]) == 151 and (500, False) in found[0]
