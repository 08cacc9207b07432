import math
import random
import re
from collections import Counter, defaultdict

from trellis.llm import linededup


def ends(parsed):
    """Both ends of every line with the line's rough length."""
    return {(tag, end, round(2 * math.log2(len(p)))) for p in parsed if p for tag, end in (("first", p[:2]), ("last", p[-2:]))}


def brute(rows, min_docs):
    """The template tree, copies by all pairs of texts that share a candidate template, and their groups."""
    n, enough = linededup, lambda p: min(linededup.LONG_DOCS, min_docs) if p >= linededup.LONG else min_docs
    parse = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\x0b\f\r]+", line) if t)
    parsed = [[parse(x) for x in (t or "").split("\n")] for _, t in rows]
    counts = Counter(p for own in parsed for p in {p for p in own if len(p) >= n.MIN_TOKENS})
    leaves = defaultdict(list)
    for p in counts:
        if n.LEADING < len(p) < n.LONG:
            leaves[len(p), p[: n.LEADING]].append(p)
    template = {p: ("line", p) for p in counts}
    for own in leaves.values():
        support = Counter()
        for p in own:
            support.update({(i, t): counts[p] for i, t in enumerate(p)})
        for p in own if len(own) > 1 and sum(counts[p] for p in own) >= min_docs else []:
            form = tuple(t if i < n.LEADING or support[i, t] >= min_docs else None for i, t in enumerate(p))
            if 2 * sum(t is not None for t in form) > len(p) and sum(t is not None for t in form) >= 3 and None in form:
                template[p] = ("form", form)
    total = Counter()
    for p, t in template.items():
        total[t] += counts[p]
    recurring = {p for p, t in template.items() if total[t] >= enough(len(p))}
    texts = defaultdict(set)
    for (_, t), own in zip(rows, parsed):
        for p in recurring & set(own):
            texts[template[p]].add(t)
    texts = {t: x for t, x in texts.items() if len(x) >= enough(len(t[1]))}
    of = {t: ends(own) for (_, t), own in zip(rows, parsed)}
    weigh = lambda e: sum(math.floor(16 * 2 ** (x[2] / 2)) for x in e)
    root = {t: t for t in of}
    for a, b in {(a, b) for x in texts.values() for a in x for b in x if a != b}:
        if 4 * weigh(of[a] & of[b]) >= 3 * weigh(of[a] | of[b]) and root[a] != root[b]:
            old, new = root[a], root[b]
            root = {t: new if r == old else r for t, r in root.items()}
    hot = {t for t, x in texts.items() if len({root[a] for a in x}) >= enough(len(t[1]))}
    out = []
    for (d, t), own in zip(rows, parsed):
        hit = [p in recurring and template[p] in hot for p in own]
        text = "\n".join(x for x, h in zip((t or "").split("\n"), hit) if not h) if any(hit) else t
        out.append((d, text, 0 if t is None else len(own), sum(p in recurring for p in own), sum(hit)))
    return sorted(out, key=str)


def test_equal_brute_force(spark, edge_docs, no_docs):
    made = [(i, f"Own line of the document {chr(97 + i)} here and there with its words.\nPublished on 2024-01-{i:02d} by editor no {i}.\nAll  rights\treserved here now.\nshort one\nown tail {chr(97 + i)} b c d e f g") for i in range(9)]
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abcdefghij", k=4))
    made += [(40 + i, f"Written by {name()} {name()} for the {'news' if i % 2 else 'daily'} desk\nSigned in {name()} as {name()}\nthe tale of {name()} {name()} {name()}") for i in range(12)]
    made += [(60 + i, " ".join(["passage", *(chr(97 + j % 26) for j in range(55))]) + "\n" + " ".join(name() for _ in range(40))) for i in range(2)]
    made += [(3, made[3][1]), (20, "Published on 7 by editor no 8."), (None, made[1][1]), (21, None), (22, "")]
    small = spark.createDataFrame(made, "doc_id bigint, text string")
    for docs in (small, edge_docs):
        for n in (2, linededup.MIN_DOCS):
            want = brute([(r.doc_id, r.text) for r in docs.collect()], n)
            assert sorted(map(tuple, linededup.cleaned(docs, min_docs=n).collect()), key=str) == want
    got = {d: (text, dropped) for d, text, _, _, dropped in brute(made, 5)}
    assert all("Written by" not in got[40 + i][0] and "tale" in got[40 + i][0] for i in range(12)) and got[60][1] == 1 and any(x[1] == 2 for x in got.values())
    assert linededup.cleaned(no_docs).count() == 0


def test_copies_keep_their_lines(spark):
    """A group of near copies loses no line to itself, while a line shared by other documents goes everywhere."""
    body = [f"line {chr(97 + i)} of a text that is copied many times over" for i in range(8)]
    docs = [(i, "\n".join([*body[:j], "edited here as a word was changed", *body[j + 1 :], "Subscribe to our letter today"])) for i, j in enumerate([0, 1, 2, 3, 4, 5, 6, 7])]
    docs.append((8, "\n".join([*body[:3], *(f"own {chr(97 + i)} line of the ninth text with more words {chr(97 + i)}" for i in range(7))])))
    docs += [(20 + i, f"Text {chr(97 + i)} with words of its own and some more {chr(97 + i)}\nSubscribe to our letter today") for i in range(6)]
    got = {r.doc_id: r for r in linededup.cleaned(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sorted((tuple(r) for r in got.values()), key=str) == brute(docs, linededup.MIN_DOCS)
    assert got[8].n_dropped == 0 and all(got[i].n_dropped == 1 for i in (0, 7, 20, 25))


def test_stage_keeps_columns_and_updates_length(spark, edge_docs):
    out = linededup.drop_recurring_lines(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    docs = spark.createDataFrame([(i, f"The same footer for all pages.\n{chr(97 + i)} b c d e f g h i j", 0) for i in range(6)], "doc_id bigint, text string, n_chars bigint")
    for r in linededup.drop_recurring_lines(docs).collect():
        assert r.text == f"{chr(97 + r.doc_id)} b c d e f g h i j" and r.n_chars == len(r.text)


def words(tag, n):
    return " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))


def staged(spark, docs):
    return {r.doc_id: r.text for r in linededup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}


def test_stage_drops_a_long_footer_from_short_documents_and_spares_copies(spark):
    """Six short texts under a licence lose it though it is most of them; eight near copies and six filled-in forms keep their lines."""
    licence = words("lic", 40)
    docs = [(i, f"{words('own' + chr(97 + i), 12)}\n{licence}") for i in range(6)]
    body = [words("body" + chr(97 + i), 30) for i in range(8)]
    docs += [(10 + i, "\n".join([*body[:i], body[i].replace(words("body" + chr(97 + i), 2), f"edited{chr(97 + i)} words"), *body[i + 1 :]])) for i in range(8)]
    docs += [(30 + i, f"Order {i}1 of {i}2 at {i}3 for {i}4\nPaid {i}5 by {i}6 on {i}7") for i in range(6)]
    got = staged(spark, docs)
    assert all(got[d] == t.replace("\n" + licence, "") for d, t in docs)


def test_stage_drops_long_passages_of_two_unlike_documents(spark):
    long, short = words("passage", 60), words("brief", 40)
    docs = [(i, f"{words('own' + chr(97 + i), 70)}\n{long}\n{short}") for i in range(2)]
    copied = [words("copied" + chr(97 + i), 60) for i in range(6)]
    docs += [(10 + i, "\n".join([*copied, f"Added later by {chr(97 + i)} to it"])) for i in range(3)]
    got = staged(spark, docs)
    assert all(got[d] == t.replace("\n" + long, "") for d, t in docs) and all(long not in t for t in got.values())


def test_copies_between_unlike_texts_of_lowest_and_highest_hash(spark):
    """Three near copies between two unlike texts (by hash): every pair counts, so the shared line isn't one of five."""
    shared = words("shared", 12)
    body = [words("body" + chr(97 + i), 20) for i in range(4)]
    texts = ["\n".join([*body, f"tail {chr(97 + k)} of it", shared]) for k in range(3)] + [words("other" + chr(97 + k), 80) + "\n" + shared for k in range(40)]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    copies = sorted(hashes[t] for t in texts[:3])
    low = next(t for t in texts[3:] if hashes[t] < copies[0])
    high = next(t for t in texts[3:] if hashes[t] > copies[-1])
    docs = list(enumerate([*texts[:3], low, high]))
    got = sorted(map(tuple, linededup.cleaned(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(docs, linededup.MIN_DOCS)
    assert all(r[4] == 0 for r in got)


def test_crowded_copies_equal_brute_force(spark):
    """Groups of near copies of more texts than are paired, with chains and strangers among them, at every crowd."""
    rng = random.Random(12)
    stock = [words("stock" + chr(97 + i), rng.randint(3, 25)) for i in range(14)]
    own = lambda: words("own" + "".join(rng.choices("abcdefgh", k=4)), rng.randint(4, 30))
    docs = []
    for family in range(3):
        base = rng.sample(stock, 9)
        for _ in range(22):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = own() if rng.random() < 0.7 else rng.choice(stock)
            docs.append((len(docs), "\n".join(text)))
    docs += [(len(docs) + i, "\n".join([*rng.sample(stock, 3), *(own() for _ in range(rng.randint(0, 5)))])) for i in range(25)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    old = linededup.CROWD
    for n in (4, 9, 14):
        want = brute(docs, n)
        assert sorted(map(tuple, linededup.cleaned(frame, min_docs=n).collect()), key=str) == want
    lines = linededup.parsed(frame)
    held = lines.select("text_hash", linededup.F.explode("lines").alias("x")).where("x.node IS NOT NULL").select("text_hash", "x.node.n_tokens", "x.node.lead", linededup.F.col("x.node.leaf").alias("template")).distinct()
    groups = [sorted(map(tuple, linededup._groups(lines, held, crowd).collect())) for crowd in (1, 5, old, 1000)]
    assert all(g == groups[0] for g in groups) and groups[0]
