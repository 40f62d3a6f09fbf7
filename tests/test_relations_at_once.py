"""The tagger over many sentences at once: what it reads, and what it gives."""

import random

import numpy as np
import pyarrow as pa

from scholia.operators import relations as R


def test_sentences_are_read_once_whatever_the_rounds(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(["the", "lens", "bends", "light"],), (["it", "is", "über"],), (["a" * 3],)] * 20, "words array<string>")
    tagger, fits = R.learnt(rows.mapInArrow(counted, rows.schema), rounds=4)
    assert len(fits) == 4 and tagger.symbols == sorted({"the", "-ens", "-nds", "-ght", "it", "is", "-ber", "-aaa"})
    assert seen.value == 60


def test_phrases_and_triples_of_many_sentences_are_those_of_each():
    rng = random.Random(4)
    told = [[rng.choice(("the", "lens", "bends", "is", "shows", "has", "of", "red", "eye", "über-x")) for _ in range(rng.choice((1, 1, 2, 5, 9, 30)))] for _ in range(400)]
    tags = [[rng.randrange(len(R.TAGS)) for _ in s] for s in told]
    words, flat = pa.array([w for s in told for w in s]), np.array([t for s in tags for t in s], np.int8)
    of = np.repeat(np.arange(len(told)), [len(s) for s in told])
    first = np.append(True, np.diff(of) > 0)
    start, _, label = R._phrases(words, flat, first)
    assert sorted(zip(of[start].tolist(), label.to_pylist(), strict=True)) == sorted((i, x[2]) for i, (s, t) in enumerate(zip(told, tags, strict=True)) for x in R.phrases(s, t))
    at, columns = R._triples(words, flat, first)
    assert sorted(zip(of[at].tolist(), *(c.to_pylist() for c in columns), strict=True)) == sorted((i, *x) for i, (s, t) in enumerate(zip(told, tags, strict=True)) for x in R.triples_of(s, t))
