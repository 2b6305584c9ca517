import random

from claimlens.llm.decontaminate import contaminated, without_leaks

QUESTION = "If Mary buys 12 apples and 7 pears for $ 30 then how many apples does Mary have when she gives 12 of them to John?"


def test_slots(frame):
    docs = frame(
        [
            (1, "Noise. If Sarah buys 45 apples and 9 pears for $ 88 then how many apples does Sarah have when she gives 45 of them to Paul? More noise."),
            (2, "If Sarah buys 45 apples and 9 pears for $ 88 then how many apples does Kim have when she gives 3 of them to Paul?"),
            (3, "before\n" + QUESTION + "\nafter " * 40_000),
            (4, None), (5, ""), (6, "If Mary buys 12"), (None, QUESTION), (7, QUESTION), (7, QUESTION),
            (8, "if you buy apples and pears then how many apples do you have when you give some of them to others"),
        ]
    )
    items = frame([(1, QUESTION), (2, None), (3, ""), (4, "Two words"), (None, QUESTION)], "item_id int, text string")
    found = {(r["doc_id"], r["item_id"]): r["match"] for r in contaminated(docs, items).collect()}
    assert found == {(1, 1): "reparameterised", (3, 1): "verbatim", (7, 1): "verbatim"}
    kept = sorted(r["doc_id"] or 0 for r in without_leaks(docs, items).collect())
    assert kept == [0, 2, 4, 5, 6, 8]
    assert without_leaks(docs, items).columns == docs.columns


def test_planted(frame):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(30)]
    docs, wanted = [], set()
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 200))]
        if d % 4 == 0:
            i, text = rng.choice(items)
            words[len(words) // 2 : len(words) // 2] = text.split()
            wanted.add((d, i))
        docs.append((d, " ".join(words)))
    found = contaminated(frame(docs), frame(items, "item_id int, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted


WORDS = "the red boats carry ripe melons over a calm river while old men sing about 5 km by 5 km of land and nobody there knows where the young captain of that ship has gone since last winter began".split()


def test_edits_that_shift_an_item(frame):
    item, half = " ".join(WORDS), len(WORDS) // 2
    long = " ".join(f"{a}{b}" for a in "bcdfghjk" for b in "aeioulmnrs")
    docs = [
        (1, "x " * 30 + " ".join(WORDS[:half] + ["really"] + WORDS[half:]) + " y" * 30),
        (2, "x " + " ".join(WORDS[:half] + WORDS[half + 1 :]) + " y"),
        (3, "x " + item.replace("5 km by 5 km", "5 km by 5km") + " y"),
        (4, "so we hear that Maria Lopez has 3 boats and that Jo sells 4 of them to her uncle in town"),
        (5, "z " * 20 + " ".join(long.split()[20:60]) + " z" * 20),
        (6, "They ask: what is the capital? Nobody says so in this place."),
        (7, " ".join(reversed(WORDS))),
        (8, " ".join(WORDS[:10]) + " other words stand here and go on for long"),
        (9, "they ask what is a country and what is the town of these people"),
    ]
    items = [(1, item), (2, "so we hear that Ann has 3 boats and that Jo sells 4 of them to her uncle in town"), (3, long), (4, "What is the capital?")]
    found = {(r["doc_id"], r["item_id"]): r["match"] for r in contaminated(frame(docs), frame(items, "item_id int, text string")).collect()}
    assert found == {(1, 1): "verbatim", (2, 1): "verbatim", (3, 1): "verbatim", (4, 2): "reparameterised", (5, 3): "verbatim", (6, 4): "verbatim"}


def test_contrary_slots_and_names_that_begin_sentences(frame):
    names = "Tom goes to the market with his dog. Tom buys nine green apples for the cake. Tom comes home and sleeps a while."
    items = [(1, QUESTION), (2, "we keep 3 red apples and then add 5 more of those to fill the box"), (3, "there were 2 apples left for them to eat in 2 days"), (4, names)]
    docs = [
        (1, "a " + QUESTION.replace("gives 12", "gives 21") + " b"),
        (2, "a we keep 4 red apples and then add 4 more of those to fill the box b"),
        (3, "a there were 3 apples left for them to eat in 4 days b"),
        (4, "Some text. " + names.replace("Tom", "Anna") + " More text."),
        (5, "as they say If Mary buys 12 apples" + QUESTION[len("If Mary buys 12 apples") :]),
    ]
    found = {(r["doc_id"], r["item_id"]): r["match"] for r in contaminated(frame(docs), frame(items, "item_id int, text string")).collect()}
    assert found == {(1, 1): "reparameterised", (2, 2): "reparameterised", (3, 3): "reparameterised", (4, 4): "reparameterised", (5, 1): "verbatim"}


def test_empty(frame):
    items, docs = frame([(1, QUESTION)], "item_id int, text string"), frame([(1, QUESTION)])
    assert contaminated(docs.limit(0), items).collect() == []
    assert contaminated(docs, items.limit(0)).collect() == []


def test_lists_of_numbers_are_no_copies_of_each_other(frame):
    import time

    rng = random.Random(8)
    numbers = lambda n: " ".join(str(rng.randint(1, 9999)) for _ in range(n))
    listed = numbers(60)
    items = [(1, listed), (2, "1 km 2 km 3 km 4 km 5 km"), (3, "take 3 and 4 and 5 and 6 and 7"), (4, "solve 3 x + 4 y = 10 and then 2 x - y = 5 for x and y")]
    docs = [
        (1, numbers(6000)), (2, "5 kg 6 kg 7 kg 8 kg 9 kg"), (3, "so " + listed + " it is"), (4, "give 8 and 9 and 1 and 2 and 4"),
        (5, "solve 7 x + 9 y = 31 and then 5 x - y = 8 for x and y"), (6, "km kg " * 3000), (7, "1 km 2 km 3 km 4 km 5 km"),
    ]
    begun = time.time()
    found = {(r["doc_id"], r["item_id"]): r["match"] for r in contaminated(frame(docs), frame(items, "item_id int, text string")).collect()}
    assert found == {(3, 1): "verbatim", (5, 4): "reparameterised", (7, 2): "verbatim"}
    assert time.time() - begun < 60


def test_repeated_phrases_are_dealt_by_diagonal(frame):
    phrase = "the red boats carry ripe melons over a calm river "
    docs = [(1, phrase * 700), (2, "none of it")]
    found = contaminated(frame(docs), frame([(1, phrase * 6)], "item_id int, text string")).collect()
    assert [(r["doc_id"], r["match"], r["covered"]) for r in found] == [(1, "verbatim", 1.0)]


def test_texts_read_together_are_read_as_each_alone():
    import numpy as np

    from claimlens.llm.decontaminate import Templates

    texts = [QUESTION, None, "", "One", "Tom Lee goes. Ann Lee comes to 5 km", "Lee", " ".join(WORDS), "a\nB c. D e f g h", "é 5kg 7 % Zoo"] * 3
    read = Templates()
    for wide in (1, 3, 6):
        alone, together = set(), set()
        for n, t in enumerate(texts):
            for reading in read([t]).readings():
                at, rolled = reading.windows(wide)
                alone |= {(n, int(reading.places[i]), int(h), reading.packed(i, wide), int(reading.sizes[0])) for i, h in zip(at, rolled)}
        for reading in read(texts).readings():
            at, rolled = reading.windows(wide)
            together |= {(int(reading.owner[i]), int(reading.places[i]), int(h), reading.packed(i, wide), int(reading.sizes[reading.owner[i]])) for i, h in zip(at, rolled)}
        assert alone == together
    assert read([None, ""]).kinds.dtype == np.int8
