"""Cases that a capped or narrowed method would lose."""

import random

import pytest


@pytest.mark.parametrize("n", [20, 240])
def test_near_duplicates_inside_hot_buckets(spark, n):
    """Texts on one template, pairwise just under the threshold, with some pairs over it."""
    from polyrisk.llm.neardup import near_duplicates

    rng = random.Random(n)
    words = [f"t{i}" for i in range(400)]
    texts, want = [], []
    for i in range(n):
        # 400 shared words and 36 own ones: 400 / 472 < 0.85; a twin shares 8 of these: 408 / 464 > 0.85.
        pair = i // 2 if i < n // 2 else None
        own = [f"p{pair}.{k}" if pair is not None and k < 8 else f"w{i}.{k}" for k in range(36)]
        texts.append((i, " ".join(rng.sample(words + own, 436))))
        want.append(i - i % 2 if pair is not None and (i ^ 1) < n // 2 else i)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, width=1).collect()}
    assert got == dict(enumerate(want))


def test_html_keeps_short_lines_at_both_ends():
    from polyrisk.llm.htmltext import main_text

    body = "".join(f"<p>{('word%d ' % i) * 30}</p>" for i in range(8))
    tail = "".join(f"<p>{'x' * n}</p>" for n in (30, 25, 20, 15))
    want = " ".join(["Heading", "By a writer", *(" ".join([f"word{i}"] * 30) for i in range(8)), *("x" * n for n in (30, 25, 20, 15))])
    menu, foot = "<div id=sidebar><p>menu</p></div>", "<div class=footer>foot</div>"
    # In one element; the heading in another one; everything right below the body.
    assert main_text(f"<body>{menu}<div><h1>Heading</h1><p>By a writer</p>{body}{tail}</div><div>other</div>{foot}") == want
    assert main_text(f"<body>{menu}<div><div><h1>Heading</h1><p>By a writer</p></div><div>{body}{tail}</div></div>{foot}") == want
    assert main_text(f"<body>{menu}<h1>Heading</h1><p>By a writer</p>{body}{tail}{foot}") == want
    # One long line: the short closing paragraph beside it stays.
    assert main_text("<div><div>" + "word " * 60 + "</div><div>short end</div></div>") == ("word " * 60) + "short end"


def test_pii_common_layouts(spark):
    import re

    from pyspark.sql import functions as F

    from polyrisk.llm.pii import FIRST_DAY, _move_day, pseudonymise

    values = "(555) 123-4567|555-123-4567|+1-555-123-4567|+1 (555) 123-4567|1-555-123-4567|555.123.4567|+44 20 7946 0958|+442079460958|3782 822463 10005|1899-05-01|0004-02-29|9999-12-31|12/31/1999|31/12/1999|31.12.1999|1999/12/31|30/02/1999|1.2.3"
    frame = spark.createDataFrame([(i, f"at {v}, or") for i, v in enumerate(values.split("|"))], "doc_id int, text string")
    got = [r.text for r in pseudonymise(frame, "k").orderBy("doc_id").collect()]
    assert all(t.startswith("at ") and t.endswith(", or") for t in got)
    got = [t[3:-4] for t in got]
    for new, old in zip(got[:-2], values.split("|"), strict=False):
        assert new != old and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old), (new, old)
    assert got[-2:] == ["30/02/1999", "1.2.3"]
    national = [re.sub(r"\D", "", t)[-10:] for t in got[:6]]
    assert len(set(national)) == 1 and got[6].startswith("+44 ") and got[2].startswith("+1-")
    # One day in several layouts has one pseudonym; day/month dates stay apart from month/day ones.
    iso = [re.split(r"\D", got[k]) for k in (12, 14, 15)]
    assert (iso[0][2], iso[0][0], iso[0][1]) == tuple(iso[2]) == tuple(reversed(iso[1]))
    assert int(got[13][:2]) > 12
    for low, high in ((-693595, -584388), (2921940, 2958464), (-146097, -140000)):
        days = spark.range(low, high).select(_move_day(F.col("id"), "k").alias("d"))
        n, first, last = days.agg(F.countDistinct("d"), F.min("d"), F.max("d")).first()
        assert n == high - low and low <= first and last < (high if high != -140000 else 0)
    ends = spark.sql(f"SELECT datediff(DATE '0001-01-01', DATE '{FIRST_DAY}'), datediff(DATE '9999-12-31', DATE '{FIRST_DAY}')").first()
    assert tuple(ends) == (-693595, 2958463)
