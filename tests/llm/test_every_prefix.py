"""Token counts at every prefix against the library, cuts inside long words included, from the table alone."""

import random

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from webloom.llm import token_counts

TEXTS = [None, "", " ", "a", "we'll they've I'm don't '", "x'll''re 'RE", "Antidisestablishmentarianism", "pneumonoultramicroscopicsilicovolcanoconiosis " * 3, "12 345,67!?", "  two  spaces\n\nand lines ", "naïve café Straße", "日本語 テキスト。", "a" * 300, "f(x)=y_1--2;" * 5, "<|endoftext|> x"]


def test_every_prefix(spark):
    rng = random.Random(9)
    words = ["the", "internationalisation", "'", "'s", "'ll", "it's", "...", "3", "1999", "é", "unbelievably", "\n", "--", "(", "Z"]
    rows = list(enumerate(TEXTS + ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 25))) for _ in range(150)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("counts", F.lit("x"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    found = token_counts.every_prefix(docs).select("doc_id", "normalised", "counts", token_counts.tokens_before(7, F.col("counts")).alias("seven"), token_counts.characters_within(5, F.col("counts")).alias("five")).collect()
    assert len(found) == len(rows)
    cuts = 0
    for r in found:
        text = rows[r["doc_id"]][1]
        if text and "<|" in text:
            assert r["counts"] is None and r["normalised"] is None
            continue
        want = [count(r["normalised"][:k]) for k in range(len(r["normalised"]) + 1)]
        assert r["counts"] == want, text
        assert want[-1] == count(text or "") and r["seven"] == want[min(7, len(want) - 1)]
        assert r["five"] == max(k for k, c in enumerate(want) if c <= 5)
        cuts += len(want)
    assert cuts > 5_000
