"""Word templates of hosts with more pages than one would hold in mind."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gridwell.llm import template


def plain_template(pages):
    """{(path, word, word)} and called paths of different pages of a host, by whole occurrence vectors."""
    need, vectors, called = max(3, (len(pages) + 1) // 2), {}, Counter()
    for k, text in enumerate(pages):
        page = template.parse(text)
        page.weigh()
        words = Counter((page.nodes[at].path, a, b) for at, own, _ in page.blocks for a, b in zip(["", *own.split()], [*own.split(), ""]))
        for t, n in (*(((0, t), n) for t, n in page.tokens.items()), *(((1, t), n) for t, n in words.items())):
            vectors.setdefault(t, []).append((k, n))
        called.update({x.path for x in page.nodes if x.mark == template.NAME and x.text and not x.heading})
    classes = {}
    for t, v in vectors.items():
        if len(v) >= need:
            classes.setdefault(tuple(v), []).append(t)
    return {t for c in classes.values() if len(c) >= 2 for is_word, t in c if is_word}, {p for p, n in called.items() if n >= need}


def test_op10_words_are_counted_over_all_pages(spark):
    """31 of 61 pages end with a phrase, and the 30 others have the lowest hashes: the first 32 pages do not show it."""
    phrase = "Read all of our terms before you copy this text"
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    rows = [(x, f"<body><div class=cell><p>{(own := line())}{' ' + phrase if x else ''}</p></div></body>", own) for x in (0, 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "x int, html string, own string").withColumn("h", F.xxhash64("html"))
    chosen = df.filter("x = 0").orderBy("h").limit(30).collect() + df.filter("x = 1").orderBy(F.desc("h")).limit(31).collect()
    pages = spark.createDataFrame([(k, "http://h.org/", p.html) for k, p in enumerate(chosen)], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in template.extract(pages).collect()} == {k: p.own for k, p in enumerate(chosen)}


def test_op10_words_match_a_plain_deduction(spark):
    """Hosts of 2 to 90 different pages, some of them copied, in several batches."""
    r, rows = random.Random(5), []
    for h, n in enumerate((2, 3, 4, 40, 90)):
        shared = [" ".join(f"s{r.randrange(30)}" for _ in range(r.randint(1, 6))) for _ in range(6)]
        for _ in range(n):
            blocks = "".join(f"<p>{' '.join(r.choice(shared) if r.random() < 0.6 else f'u{r.randrange(50)}' for _ in range(4))}</p>" for _ in range(3))
            side = "<div class=sidebar>more</div>" if r.random() < 0.55 else ""
            rows += [(f"h{h}", f"<body><div>{blocks}</div>{side}<footer>{shared[0]}</footer></body>")] * r.choice([1, 1, 1, 2, 5])
    r.shuffle(rows)
    got = {x.host: x for x in template.deduce(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()}
    for h in range(5):
        words, names = plain_template(sorted({t for x, t in rows if x == f"h{h}"}))
        own = got.get(f"h{h}")
        tokens = {template.pair_tokens([path], [text])[0][at] for path, a, b in words for text, at in ((f"{a} {b}".strip(), 1 if a and b else 0 if b else 1),)}
        assert set(own.words or () if own else ()) == tokens and set(own.names or () if own else ()) == names
    assert len(got["h4"].words) > 10
