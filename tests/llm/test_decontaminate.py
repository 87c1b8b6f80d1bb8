import random

import numpy as np

from plainfold.llm.decontaminate import Benchmark, canonical, contaminated, decontaminate, judged, matches, readings, tokens

ITEM = "A train leaves Boston at 60 miles per hour and Alice waits while Bob walks 3.5 km to meet Alice at noon."
PLAIN = "the quick brown fox jumps over the lazy dog while seven cats sleep under a warm and quiet roof tonight"


def test_canonical():
    assert canonical("The price was 3.50 dollars in Paris.\nHe paid 1,000 g") == ["the", "price", "was", "<number>", "<unit>", "in", "<name>", "he", "paid", "<number>", "<unit>"]


def test_slots_may_change_together(spark):
    fill = "some other words stand here before and behind the passage that we look for in this test"
    docs = [
        (1, f"{fill} {ITEM} {fill}"),
        (2, f"{fill}. {ITEM.replace('Alice', 'Carol').replace('60', '75').replace('Boston', 'Denver')} {fill}"),
        (3, f"{fill}. A train leaves Boston at 60 miles per hour and Alice waits while Alice walks 3.5 km to meet Bob at noon."),
        (4, fill), (5, None), (6, ""), (7, PLAIN.upper()), (8, " ".join(PLAIN.split()[:6])), (None, ITEM), (9, " ".join(PLAIN.split()[4:14]) + " " + fill),
        (10, "1 2 3 4 5 6 7 8 9 10 11 12"), (1, f"{fill} {ITEM} {fill}"), (11, (fill + " ") * 60_000 + ITEM),
    ]
    bench = [(100, ITEM), (101, PLAIN), (102, None), (103, ""), (104, "9 8 7 6 5 4 3 2 1 9 8 7"), (None, fill), (105, "short one"), (101, PLAIN)]
    docs = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, doc_id int")
    want = {(1, 100): False, (2, 100): True, (7, 101): False, (9, 101): False, (11, 100): False}
    for block in (2000, 2):
        assert {(r.doc_id, r.item_id): r.replaced for r in contaminated(docs, bench, block=block).collect()} == want
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 8, 10, None}


def found(item, *texts, **how):
    bench = Benchmark([(1, item.encode())], 8, 4)
    buf = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, buf)])
    return {d: (n, replaced) for d, _, n, replaced in matches(bench, np.frombuffer(b"".join(buf), np.uint8), offs, how.get("share", 0.5), how.get("least", 20))}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


LONG = (
    "Every morning the baker Alice carries 12 loaves of bread to the market square while her brother sells the rest from a small cart "
    "near the river bridge, and at noon they count what has been left over. On the way home Alice gives 12 loaves to the old school "
    "and asks how many are still to be sold before evening comes"
)


def test_an_edited_value_costs_only_its_windows():
    edits = [LONG, LONG.replace("home Alice", "home Carol"), LONG.replace("gives 12", "gives 13")]
    assert [found(LONG, x)[0][0] >= 50 for x in edits] == [True] * 3
    short = "We saw how Alice went to the market and bought some bread for all of us, then Alice sold it again"
    assert found(short, short.replace("then Alice", "then Carol"))[0][0] >= 10


def test_equal_words_match_whatever_their_types():
    item = "Alice paid Bob 30 dollars, Carol 12 dollars, and Dan the other 7 that were left in her purse"
    assert found(item, f"see {item}", f"x. {item}", item.lower(), item.upper()) == {i: (19, False) for i in range(4)}
    assert found("Paris lies in France", "so Paris lies in France", "so Paris lies in Spain") == {0: (4, False)}


def test_names_at_the_starts_of_sentences_may_be_replaced():
    item = "Tom has 5 apples. Tom eats 2 apples. Tom buys 4 apples. How many apples has Tom?"
    assert found(item, item.replace("Tom", "Sam"), f"Now: {item.replace('Tom', 'Sam')}", f"so {item.replace('Tom', 'Sam')}") == {i: (17, True) for i in range(3)}
    ends = "Tom has 5 red apples. Tom eats 2 green apples. How many are still left over now?"
    assert found(ends, ends.replace("Tom", "Sam")) == {0: (17, True)}


def test_words_put_in_and_names_of_more_words():
    item = (
        "a young man walks along the shore of Paris with a heavy bag while his old friend stays behind in Paris to look after "
        "the house and the small garden until he is back again from his long walk"
    )
    moved = item.replace("bag while", "bag one day while").replace("garden until", "garden there until").replace("shore of", "shore and beach of")
    n = len(canonical(item))
    assert found(item, item.replace("Paris", "New York")) == {0: (n, True)}
    assert found(item, moved) == {0: (26, False)}
    short = "the man who lives in Paris has two sons and one of them is a baker in Paris today"
    assert found(short, short.replace("Paris", "New York"), short.replace("lives in Paris", "lives in New York")) == {0: (19, True), 1: (19, True)}
    for text in (short, "Paris is a town that is as old as the sea and Tom was in Paris"):
        for around in (f"so Ann {text}", f"{text} Ann", f"Ann {text} Lee Ann"):
            assert found(text, around) == {0: (len(canonical(text)), False)}


def test_numbers_as_words_and_units_by_their_place():
    item = "In New York a baker sells 12 loaves in the morning and 30 loaves at noon. How many loaves does he sell in New York?"
    n = len(canonical(item))
    assert found(item, item.replace("New York", "Chicago").replace("30", "41")) == {0: (n, True)}
    assert found(item, item.replace("12", "twenty-one").replace("30", "forty")) == {0: (n, True)}
    assert found(item, item.replace("loaves", "rolls").replace("12", "9")) == {0: (n, True)}
    assert found(item, item.replace("12 loaves", "twelve cakes").replace("30 loaves", "thirty cakes").replace("many loaves", "many cakes")) == {0: (n, True)}


def problems(seed, n=40):
    """Questions, texts that hold them with other names, numbers and units, by kind of change, and texts that hold none."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiou" if j % 2 else "bdklmnrst") for j in range(rng.randrange(3, 8))) for _ in range(250)]
    names, things, units = ["Tom", "Alice", "Boris", "Wanda", "Igor", "Selma"], ["apples", "books", "stones", "coins", "tickets"], ["km", "miles", "hours", "kg", "litres"]
    words = lambda k: " ".join(rng.choice(plain) for _ in range(k))
    items, docs, truth, kinds = [], [], set(), {}
    for i in range(n):
        a, b = rng.sample(names, 2)
        thing, unit, (x, y) = rng.choice(things), rng.choice(units), rng.sample(range(2, 99), 2)
        fill = [words(rng.randrange(3, 6)) for _ in range(5)]

        def text(a=a, b=b, x=x, y=y, thing=thing, unit=unit, fill=fill):
            return f"{a} {fill[0]} {x} {thing} {fill[1]} and {b} {fill[2]} {y} {unit} {fill[3]}. How many {thing} {fill[4]} when {a} meets {b}?"

        items.append((i, text()))
        for kind, t in {
            "verbatim": text(), "numbers": text(x=x + 100, y=y + 200), "names": text(a="Zeno", b="Olga"), "longer names": text(a="Mary Ann", b="Old Joe Black"), "spelled": text(x="seven", y="forty-two"),
            "units": text(unit="furlongs"), "things": text(thing="pebbles"), "all": text(a="Zeno", b="Olga", x=111, y=222, thing="pebbles", unit="furlongs"),
        }.items():
            docs.append((len(docs), f"{words(30).capitalize()}. {t} {words(20).capitalize()}."))
            truth.add((docs[-1][0], i))
            kinds[docs[-1][0]] = kind
    for _ in range(4 * n):  # of the same shape and words, but other questions
        a, b = rng.sample(names, 2)
        docs.append((len(docs), f"{words(20).capitalize()}. {a} {words(4)} {rng.randrange(99)} {rng.choice(things)} {words(5)} and {b} {words(4)} {rng.randrange(99)} {rng.choice(units)} {words(3)}. How many {rng.choice(things)} {words(4)} when {a} meets {b}?"))
    return items, docs, truth, kinds


def test_planted_questions_of_all_kinds_are_found(spark):
    """The figures that the README gives."""
    items, docs, truth, kinds = problems(3)
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.replaced for r in rows}
    print({k: f"{sum(p in got for p in truth if kinds[p[0]] == k)} of {sum(kinds[p[0]] == k for p in truth)}" for k in dict.fromkeys(kinds.values())}, f"others: {len(set(got) - truth)}, replaced: {sum(got.values())}")
    assert len(set(got) & truth) >= 0.9 * len(truth) and len(set(got) & truth) >= 0.9 * len(got)
    for kind in set(kinds.values()):
        mine = {p for p in truth if kinds[p[0]] == kind}
        assert len(mine & set(got)) >= 0.9 * len(mine), kind
        assert all(got[p] == (kind != "verbatim") for p in mine & set(got))


def brute(items, docs, size=8, literal=4, share=0.5, least=20):
    """Every window of every item against every window of every document, token by token, without hashes or blocks."""
    def read(text):
        buf = np.frombuffer((text or "").encode(), np.uint8)
        t = tokens(buf, np.array([0, len(buf)]))
        return t, readings(t)

    out, known = {}, {i: read(text) for i, text in items if i is not None and text is not None}
    for d, text in docs:
        if d is None:
            continue
        t, reads = read(text)
        for i, (u, i_reads) in known.items():
            diagonals = {}
            for r, (mine, theirs) in enumerate(zip(i_reads, reads, strict=True)):
                n = min(size, len(mine.doc))
                for p in range(len(mine.doc) - n + 1):
                    if n and (~mine.slot[p : p + n]).sum() >= min(literal, n):
                        for q in range(len(theirs.doc) - n + 1):
                            if (mine.code[p : p + n] == theirs.code[q : q + n]).all() and (~theirs.slot[q : q + n]).sum() >= min(literal, n):
                                diagonals.setdefault((r, q - p), set()).add(p)
            if diagonals and (best := judged((u.word, u.full, i_reads), t.word, t.full, reads, diagonals, size, share, least)):
                out[d, i] = best
    return out


def test_equals_brute_force_in_blocks_of_any_size(spark):
    items, docs, _, _ = problems(5, 4)
    items += [(100, "short one here"), (101, None), (102, ""), (103, items[0][1])]
    docs = docs[:40] + [(1000, None), (1001, ""), (1002, "so short one here"), (1003, "1 2 3 4 5 6 7 8 9")]
    want = brute(items, docs)
    d, b = spark.createDataFrame([*docs, (None, items[0][1])], "doc_id long, text string").repartition(3), spark.createDataFrame([*items, (None, "x")], "item_id long, text string")
    for how in ({}, {"block": 2}, {"block_bytes": 1}):
        assert {(r.doc_id, r.item_id): (r.n_tokens, r.replaced) for r in contaminated(d, b, **how).collect()} == want
    assert len(want) >= 32
