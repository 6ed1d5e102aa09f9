"""License scans and hard negatives against plain versions of them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(license_scan.UPPER, license_scan.LOWER)


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def best_share(words, template, merge):
    """Largest share of the template's words in runs of three that lie on neighbouring diagonals."""
    runs = {}
    for q in range(len(template) - 2):
        runs.setdefault(tuple(template[q : q + 3]), []).append(q)
    hits = {(p - q, q) for p in range(len(words) - 2) for q in runs.get(tuple(words[p : p + 3]), [])}
    reach = license_scan.SHIFT if merge else 0
    return max((len({q + i for e, q in hits if abs(e - d) <= reach for i in range(3)}) / len(template) for d in {d for d, _ in hits}), default=0.0)


def expected(text):
    words = split(text)
    base = sorted((i, label) for label, phrase in license_scan.PHRASES for i in places(words, phrase.split()))
    shares = [(best_share(words, split(t), merge), least, label) for _, _, label, t, least, merge in license_scan.TEMPLATES]
    labels = {label for share, least, label in shares if share >= least}
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max(s for s, *_ in shares)


MIT = license_scan.TEXTS[0][1]
TEXTS = [
    MIT,
    MIT.replace("free of charge", "entirely free of any charge whatever").replace("sublicense, ", ""),
    " ".join(MIT.split()[:60]),
    "x " * 50 + MIT + " y" * 70 + " " + MIT,
    "Under the MIT license. Under the\nMIT-License; under the mit licenses",
    "Apache License, Version 2.0 and CC BY-NC 4.0, cc_by_nc",
    "cc by nc " * 300,
    "This work is licensed under the GNU General Public License, version 3.",
    "the GNU Lesser General Public License, version 3",
    "É mit é under the İ mit license",
    "under the mit",
    "the and of in",
]


def test_license_scan_against_plain_version(spark, nasty_rows):
    rows = [(i, t) for i, t in enumerate(TEXTS + [r[1] for r in nasty_rows])]
    got = {r["doc_id"]: r["__license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert tuple(got[i]) == expected(text), text and text[:80]
    assert [got[i]["labels"] for i in (0, 1, 2, 7, 8)] == ["mit", "mit", "", "gpl-3", "lgpl"]


def test_license_scan_on_awkward_rows(spark, nasty, nothing):
    extra = nasty.withColumns({c: F.lit("x") for c in ("labels", "n_base", "first_word", "key", "t", "d", "share")})
    got = license_scan.scan(extra)
    assert got.columns == [*extra.columns, "__license"] and got.count() == extra.count()
    assert license_scan.scan(nothing).count() == 0 and license_scan.spans(nothing).count() == 0
    same = spark.createDataFrame([(None, TEXTS[4])] * 50 + [(1, TEXTS[4])] * 3, "doc_id long, text string")
    assert {(r["doc_id"], r["__license"]["n_base"], r["__license"]["first_word"], r["__license"]["last_word"]) for r in license_scan.scan(same).collect()} == {(None, 2, 0, 4), (1, 2, 0, 4)}


def test_license_spans(spark):
    rows = license_scan.spans(spark.createDataFrame([(1, TEXTS[3]), (2, TEXTS[1])], "doc_id long, text string")).where("kind = 'text'").orderBy("doc_id", "first_word").collect()
    n = len(split(MIT))
    assert [(r["doc_id"], r["label"], r["first_word"], r["last_word"]) for r in rows[:2]] == [(1, "mit", 50, 50 + n - 1), (1, "mit", 120 + n, 120 + 2 * n - 1)]
    assert len(rows) == 3 and rows[2]["first_word"] == 0 and 0.8 <= rows[2]["share"] < 1


def test_license_scan_runs_no_python(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# hard negatives


def mined(rows, anchors, k=5, m=3):
    """All anchors against all rows, in whole numbers of Python."""
    out = set()
    for i, (label, v) in rows.items():
        if not anchors(i):
            continue
        score = {j: sum(a * b for a, b in zip(v, w)) for j, (_, w) in rows.items() if j != i}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if rows[j][0] == label][:k]:
            inside = [j for j in order if rows[j][0] != label and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            out |= {(i, p, r, j, score[p], score[j]) for r, j in enumerate(inside[:m], 1)}
    return out


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(size=12) * 0.7).astype("float32").tolist(), int(rng.integers(4))) for i in range(400)]
    rows += [(1000 + i, rows[3][1], i % 4) for i in range(60)]  # copies under all labels
    rows += [(2000, [0.0] * 12, 1), (2010, [float(x) for x in -np.ones(12)], 1), (2020, [3.0e4] * 12, 2)]
    fine = {i: (y, whole(v)) for i, v, y in rows}
    odd = [(3000, None, 1), (3010, [1.0] * 11 + [None], 1), (3020, [1.0] * 11 + [float("nan")], 1), (3030, [float("inf")] * 12, 1), (3040, [1.0] * 12, None), (3050, [], 1), (3060, [1.0] * 3, 1), (None, [1.0] * 12, 1), (3070, [1.0e30] * 12, 1)]
    df = spark.createDataFrame(rows + odd + rows[:7], "vec_id long, embedding array<float>, label long").withColumns({"score": F.lit(1), "rank": F.lit("x"), "code": F.lit(0)}).repartition(5)
    got = hard_negatives.mine(df, F.pmod("id", F.lit(10)) == 0, F.col("label"))
    want = mined(fine, lambda i: i % 10 == 0)
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == want and len(want) > 300


def test_hard_negatives_without_rows(spark):
    schema = "vec_id long, embedding array<float>, label long"
    every = F.lit(True)
    assert hard_negatives.mine(spark.createDataFrame([], schema), every, F.col("label")).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, None, 1), (2, [1.0], None)], schema), every, F.col("label")).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema), every, F.col("label")).count() == 0


def test_repeated_ids_count_once(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.9, 0.0], 2), (2, [1.0, 0.0], 1), (3, [0.75, 0.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long"), F.col("id") == 1, F.col("label"))
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1, 3, 65536, 49152)]


def test_bounds_hold_and_select(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    fine = hard_negatives.usable(table, F.col("label"), "vec_id", "embedding", 256)
    grid = hard_negatives.grid_of(fine, 64, fine.count())
    rows = fine.toPandas()
    v, ids, labels = np.stack(rows["v"]), rows["id"].to_numpy(), rows["label"].to_numpy()
    known, scored = hard_negatives.Approximations(grid, grid.codes(v)), []
    for i in range(0, len(v), 50):
        low, high = (x[0] for x in known.bounds(v[i : i + 1]))
        exact = v @ v[i]
        assert (low <= exact).all() and (exact <= high).all()
        near = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
        at, best, n = hard_negatives.best_positives(v[near], ids[near], low[near], high[near], v[i], 5)
        assert best.tolist() == sorted(exact[near], reverse=True)[:5]
        scored.append(n / len(near))
        windows = [((50 * p + 99) // 100, 95 * p // 100) for p in best.tolist()]
        _, n = hard_negatives.window_negatives(v, ids, labels != labels[i], low, high, v[i], windows, 3)
        scored.append(n / (labels != labels[i]).sum())
    assert np.mean(scored) < 0.2


def test_values_beyond_the_sample_stay_inside_their_cell():
    cuts = np.tile(np.arange(hard_negatives.CELLS - 1), (2, 1))
    codes = hard_negatives.Grid(cuts, cuts, cuts).codes(np.array([[-100, 5], [1000, 62]]))
    assert codes.tolist() == [[0, 6], [63, 63]]


def test_products_are_exact():
    rows, anchor = np.array([[1 << 26, 3]]), np.array([(1 << 27) + 1, 5])
    assert hard_negatives.products(rows, anchor).tolist() == [(1 << 26) * ((1 << 27) + 1) + 15]
