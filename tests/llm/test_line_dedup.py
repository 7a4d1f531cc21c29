from shiftcast.llm.line_dedup import dedup_lines


def expected(rows):
    first = {}
    for i, t in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault("\n".join(lines[p:p + 3]), (i, p))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            key = "\n".join(lines[p:p + 3])
            if key.strip(" \t\r\n") and first[key] != (i, p):
                gone |= {p, p + 1, p + 2}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_matches_brute_force(spark):
    block = "one\ntwo\nthree\nfour"
    rows = [(1, "a\n" + block + "\nb"), (2, "c\n" + block), (3, block), (4, "x\nx\nx\nx\nx\nx"), (5, "\n\n\n\n"),
            (6, "\n\n\n\n"), (7, ""), (8, None), (9, "one\ntwo"), (10, "a\nb\na\nb\na\nb"), (11, " \n\t\n \nend"),
            (12, " \n\t\n \nend"), (13, "tail\n"), (14, "three\nfour\nb\ntail\n"), (2, "c\n" + block), (None, block),
            (15, "long\n" * 3000 + block)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int").repartition(4)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()]
    assert order(got) == order(expected(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, covered string")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "covered", "n_lines", "n_removed"] and out.count() == 0
