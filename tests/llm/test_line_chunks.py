"""Line dedup against a plain loop over all windows of two lines, and its resistance to shifts."""

import random

from folioflow.llm import line_chunks

SCHEMA = "doc_id long, text string, first string, content string, hash string"


def brute(rows):
    """Lines of every pair of lines that occurs earlier; chunks and their boundaries play no part."""
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0]))
    seen, result = set(), {}
    for d, t in docs:
        lines, drop = t.split("\n"), set()
        for i in range(len(lines) - 1):
            pair = tuple(lines[i : i + 2])
            if "".join(pair).strip(" \t\n\v\f\r"):
                if pair in seen:
                    drop |= {i, i + 1}
                seen.add(pair)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in drop)
        result[d, t] = (d, len(lines), len(drop), len([k for k in drop if k - 1 not in drop]), kept)
    return sorted((result[r[0], r[1] or ""] for r in rows), key=str)


def test_matches_a_plain_loop(spark):
    rng = random.Random(2)
    line = lambda: " ".join("w%d" % rng.randrange(900) for _ in range(rng.randrange(1, 6)))
    blocks = [[line() for _ in range(rng.randrange(5, 30))] for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [x for _ in range(rng.randrange(1, 5)) for x in (rng.choice(blocks) if rng.random() < 0.5 else [line() for _ in range(rng.randrange(8))])]
        rows.append((i * 7 % 61, "\n".join(parts), "", "", ""))
    rows += [(100, "", "", "", ""), (101, None, "", "", ""), (None, "\n".join(blocks[0]), "", "", ""), (102, "\n\n\n\n" * 9, "", "", ""), (103, "one line", "", "", "")]
    rows += [(104, "\n".join(["the same line"] * 500), "", "", ""), (105, "x\n\n\n \ny\nx\n\n\n \ny\n\n", "", "", "")]
    rows += [(106, "\n".join(line() for _ in range(20_000)) + "\n" + "\n".join(blocks[1] * 2), "", "", "")]
    got = line_chunks.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert got.agg({"n_removed": "sum"}).first()[0] > 100
    again = [*rows, rows[0], rows[-6]]
    assert sorted(map(tuple, line_chunks.dedup_lines(spark.createDataFrame(again, SCHEMA)).collect()), key=str) == brute(again)


def test_an_inserted_line_shifts_nothing_far_away(spark):
    lines = ["line %d of the text" % i for i in range(200)]
    moved = [*lines[:50], "inserted", *lines[50:]]
    got = line_chunks.dedup_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new"] + moved))], "doc_id long, text string"))
    removed = {r["doc_id"]: r["n_removed"] for r in got.collect()}
    assert removed[1] == 0 and removed[2] > 120


def test_planted_runs_of_three_lines_go(spark):
    rng = random.Random(4)
    line = lambda: "%x %x" % (rng.randrange(10**9), rng.randrange(10**9))
    runs = [[line() for _ in range(3)] for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(rng.randrange(1, 9))] + runs[i % 40] + [line() for _ in range(rng.randrange(1, 9))])) for i in range(200)]
    got = line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_removed"] == (0 if r["doc_id"] < 40 else 3) for r in got)


def test_hot_pieces_and_longer_windows(spark, monkeypatch):
    monkeypatch.setattr(line_chunks, "HOT", 4)
    rows = [(i, "a\nb\nc\n%d\na\nb\n%d" % (i, i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_chunks.dedup_lines(docs).collect()), key=str) == brute(rows)
    three = {r["doc_id"]: r["n_removed"] for r in line_chunks.dedup_lines(docs, min_lines=3).collect()}
    assert three == {i: 3 if i else 0 for i in range(60)}


def test_equal_hashes_of_unequal_lines(spark, monkeypatch):
    real = line_chunks.F.xxhash64
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c: real(*c) % 3 if isinstance(c[0], str) and c[0] == "content" else real(*c))
    rows = [(i, "\n".join("l%d" % (i * 7 % (k + 3)) for k in range(6))) for i in range(12)]
    assert sorted(map(tuple, line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_native_plan(spark):
    plan = line_chunks.dedup_lines(spark.createDataFrame([(1, "a\nb"), (2, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunks_cover_every_line(spark):
    text = "\n".join(str(i % 17) for i in range(100)) + "\n"
    parts = line_chunks.chunk_table(spark.createDataFrame([(1, text)], "_key long, text string")).orderBy("first").collect()
    assert "\n".join(p["content"] for p in parts) == text
    assert sum(p["n_lines"] for p in parts) == 101


def test_empty_table(spark):
    assert line_chunks.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
