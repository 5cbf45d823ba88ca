"""Style trees and vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import neighbours, pivots, style_tree
from codestrata.llm.style_tree import extract, importance, parse

SF = "/root/testdata/sf0.001"


def text_of(html):
    return "\n\n".join(b.text for b in parse(html).blocks if not b.noise)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b  \n c</p>", "a b c"),
    ("<p>a<b>b<p>c</b>d", "ab\n\ncd"), ("<ul><li>x<li>y</ul>z", "x\n\ny\n\nz"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("<script>if(a<b)'</p>'</script>t<style>p{}</style>", "t"), ("a<!-- <p>no</p> -->b", "ab"), ("<nav>m</nav><div class='ad'>x</div>y<footer>f</footer>", "y"),
    ("<header>h</header><article><header>t</header>b</article>", "t\n\nb"), ("<div class='sidebar'>s</div><main>m</main>", "m"),
    ("<body class='has-sidebar'>b</body>", "b"), ("<form>f</form><div id='comments'><p>c</p></div>k", "k"), ("<p>&eacute;&#x41;&nbsp;b", "éA b"),
    ('<a title="x>y">z</a>', "z"), ("a < b", "a < b"), ("</p></div>x", "x"), ("<script>never closed", ""), ("<div hidden>h</div><p>v", "v"),
    ("one<span class=ad>two</span>three", "one three"),
])
def test_blocks(html, text):
    assert text_of(html) == text


def test_long_and_deep_pages():
    assert len(text_of("<p>word " * 100_000).split()) == 100_000
    assert text_of("<div>" * 30_000 + "x") == "x" and text_of("<b>" * 30_000 + "x") == "x"
    assert text_of('<p class="' * 20_000) != "<"


def page(n, body):
    return f"<html><body><div class=top><i>Welcome here</i></div><div class=main>{body}</div><div class=end>All rights {n % 2}</div></body></html>"


@pytest.fixture(scope="module")
def site(spark):
    """A host whose frame names itself by no word, and one of few pages."""
    rows = [(i, f"https://a.example/{i}", page(i, f"<p>Story {i} begins</p><p>and goes on {i * 7}</p>"), "x") for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i}", page(i, "<p>Same everywhere</p>"), "x") for i in range(3)]
    rows += [(200, None, "<p>no host</p>", "x"), (201, "u", None, "x"), (None, "https://a.example/z", page(9, "<p>Nameless</p>"), None), (0, "https://a.example/0", rows[0][2], "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_branches_of_low_importance_go(site):
    got = {r["page_id"]: r for r in extract(site).collect()}
    assert got[7]["text"] == "Story 7 begins\n\nand goes on 49" and got[7]["n_chars"] == len(got[7]["text"])
    assert got[None]["text"] == "Nameless" and got[200]["text"] == "no host" and got[201]["text"] == ""
    # three pages say nothing about a frame
    assert got[101]["text"] == "Welcome here\n\nSame everywhere\n\nAll rights 1"
    assert extract(site).count() == site.count() and extract(site.limit(0)).count() == 0


def test_importance_by_hand(site):
    rows = {r["path"].split(">")[-1]: r for r in importance(site.filter("url like '%a.example%'")).collect()}
    assert rows["div.top"]["importance"] == pytest.approx(0) and rows["p"]["importance"] > 0.9
    # 42 pages, two texts, on pages of even and of odd number
    m, halves = 42, [21, 21]
    plain = 1 - sum(np.log(n) / np.log(m) for n in halves) / 2
    assert rows["div.end"]["importance"] == pytest.approx(plain, abs=0.02)


def test_articles_come_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: r["html"].split("<article>")[1].split("</article>")[0] for r in pages.collect()}
    for r in extract(pages).collect():
        assert r["text"].split() == text_of(want[r["page_id"]]).split() and r["text"]


# vectors


def clustered(seed, n=240, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, (centres[i % 12] + rng.normal(size=d) * (0.05 if i % 3 else 1.5)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(30)]  # copies
    return rows


ODD = [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None] * 8), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1005, [1.0, 2.0]), (None, [1.0] * 16), (1006, [])]
SCHEMA = "vec_id long, embedding array<float>, label int, node long, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = clustered(4)
    return spark.createDataFrame([(*r, None, 1, 2) for r in rows + ODD], SCHEMA), rows


def test_pivot_links(vectors):
    df, rows = vectors
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in pivots.near_duplicate_vectors(df, 0.9, group_rows=16).collect() if r["vec_id"] is not None}
    assert len(got) == len(rows) + len(ODD) - 1
    links = np.array([got[i]["n_links"] for i in ids])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    for i, _ in ODD:
        if i is not None:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    for r in got.values():
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert got[5]["n_links"] >= 30 and {got[i]["component_id"] for i in range(240, 270)} == {got[5]["component_id"]}


def test_pivots_of_little(vectors):
    df, _ = vectors
    assert pivots.near_duplicate_vectors(df.limit(0)).count() == 0
    assert pivots.near_duplicate_vectors(df.filter("vec_id >= 1000")).count() == len(ODD) - 1
    assert [r["n_links"] for r in pivots.near_duplicate_vectors(df.filter("vec_id in (1, 2)")).collect()] == [0, 0]


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert neighbours.chi_square_quantile(0.9, 8) == pytest.approx(13.362, abs=1e-3)


@pytest.mark.parametrize("cell_rows", [32, 4096])
def test_neighbours(vectors, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    df, rows = vectors
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    hits = total = 0
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        score = (x[ids == q] * x).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [v for _, v, _ in found] == sorted([v for _, v, _ in found], key=lambda v: (-score[ids == v][0], v))
        assert all(s == pytest.approx(score[ids == v][0], rel=1e-12) for _, v, s in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        total += 20
    assert hits >= 0.9 * total


def test_neighbours_of_little(vectors):
    df, _ = vectors
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    few = neighbours.nearest(df.filter("vec_id in (1, 2, 3, 1000)"), F.lit(True)).collect()
    assert len(few) == 6


def test_neighbours_of_repeated_rows_over_many_cells_and_groups(spark, monkeypatch):
    """Rows of one id have results of their own; cells are split by their own queries only."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 256)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.float32(centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.2, size=(3000, 16)))
    ids = np.arange(3000)
    ids[1:6] = 20  # several rows with the id of a query, three of them nearest to each other
    x[1:4] = 3 * x[20]
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    want, found = {}, 0
    exact = x.astype(float) @ x.astype(float).T
    for row in np.flatnonzero(ids % 20 == 0):
        others = np.delete(np.arange(3000), row)
        best = others[np.lexsort((ids[others], -exact[row, others]))[:5]]
        for rank, at in enumerate(best, 1):
            want.setdefault((int(ids[row]), rank), []).append(round(float(exact[row, at]), 6))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for key, scores in want.items():
        mine = [round(s, 6) for _, s in got[key]]
        found += sum(s in mine for s in scores)
    assert found >= 0.97 * sum(map(len, want.values()))
    assert sum(v == 20 for v, _ in got[20, 1]) >= 4
