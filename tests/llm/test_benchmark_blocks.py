"""Several blocks of benchmark items give the rows of one block, repeated rows and ids among them."""

import collections

from sitecast.llm import decontaminate as D


def test_blocks_equal_one_block(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(15))) for i in range(12)] + [(50, "short one"), (51, None), (50, "short one")]
    texts = [f"before {items[i][1]} after {items[(i + 1) % 12][1]}" for i in range(12)] + ["nothing here", None, "", "a Short ONE", items[3][1]]
    rows = [(i % 9, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = [collections.Counter(tuple(r) for r in D.digest(D.find_contamination(docs, bench, max_chars=chars)).collect()) for chars in (10_000_000, 300, 60)]
    assert seen[0] == seen[1] == seen[2] and sum(seen[0].values()) == len(rows)
