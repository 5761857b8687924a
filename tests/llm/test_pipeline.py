import collections
import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeiou" for c in ("r", "nt", "l", "s")]
    rows, labels, toxic = [], [], set()
    for d in range(300):
        w = [rng.choice(vocabulary) for _ in range(40)]
        if d % 4 == 0:
            w[3] = w[20] = "vermin"
            toxic.add(d)
        rows.append((d, " ".join(w), "en", f"s{d % 5}", 1))
        labels.append((d, int(d in toxic), int(d in toxic)))
    rows += [(1000 + d, rows[1][1], "en", "s1", 1) for d in range(20)] + [(2000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert not kept & toxic and not any(1000 <= d < 1020 for d in kept)
    assert kept <= {d for d, *_ in rows}
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
