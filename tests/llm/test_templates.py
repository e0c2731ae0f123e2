"""Benchmark questions with other numbers, units and names."""

import random
import re

import pytest

from tests.llm.test_decontaminate import found
from tillsight.llm import decontaminate

CAR = "A car drives 60 km in 2 hours and then 90 km in 3 hours. What is its average speed?"
MARIA = "Maria has 5 apples and gives 3 to John"
ROADS = "the old road from Paris to the small harbour runs along the coast. Paris is older than the harbour and the road"
BALLS = "a box holds 3 red and 5 blue balls, how many balls must we draw to be sure"
FRUIT = (
    "a farmer picks 5 apples and 5 pears on the first day of the harvest and sells half of them at the market "
    "before the rain comes, how much fruit is left in the barn"
)


def check(spark, item, text):
    return set(found(spark, ["some words before " + text + " and some after", text], [(1, item)]))


BOTH = {(0, 1), (1, 1)}


def test_numbers_with_units(spark):
    assert check(spark, CAR, CAR.replace("60", "80").replace(" 2 ", " 4 ").replace("90", "50").replace(" 3 ", " 5 ")) == BOTH
    assert check(spark, CAR, "A list: 60 km, 2 hours, 90 km, 3 hours, 5 km, 6 hours, 7 km, 9 hours") == set()


@pytest.mark.parametrize("item, text", [
    (MARIA, "Paula has 8 apples and gives 4 to Peter"),
    (MARIA, "Paula has 8 apples and gives 4 to\nPeter"),
    (MARIA, "\"Paula has 8 apples and gives 4 to  (Peter)"),
    (MARIA, "Then Paula has 8 apples and gives 4 to Peter"),
    (ROADS, ROADS.replace("Paris", "New York")),
    (ROADS, ROADS.replace("Paris", "\nBoston")),
])
def test_names_anywhere(spark, item, text):
    assert check(spark, item, text) == BOTH


def test_numbers_that_coincide_by_chance(spark):
    assert check(spark, BALLS, BALLS.replace("3", "4").replace("5", "4")) == BOTH
    assert check(spark, FRUIT, FRUIT.replace("5 apples and 5", "8 apples and 9")) == BOTH


WORD_PROBLEMS = [
    "{A} has {n} apples and buys {m} more at the market. {B} gives {A} another {k} apples. How many apples does {A} have now?",
    "{A} bought {n} pens and {m} books for {k} dollars each. How much did {A} spend on the pens and books altogether?",
    "If {n} workers can finish building a garden wall in {m} days, how many days will {k} workers need for the same wall?",
    "{A} runs {n} km in {m} minutes and {B} runs {k} km in {j} minutes. Who runs faster, and by how many km per hour?",
    "{A} and {B} share {n} sweets in the ratio {m} to {k}. How many sweets does {B} receive after {A} takes the larger share?",
    "It rained {n} mm on Monday, {m} mm on Tuesday and {k} mm on Wednesday. What was the average rainfall over the three days?",
]
PEOPLE = ("Anna", "Peter", "Maria", "John", "Susan", "Paul", "Laura", "Omar")
OTHERS = [
    "{A} walked {n} km to the lake and {m} km back while {B} waited for {k} hours at the station near the old town hall",
    "The shop of {A} sells {n} lamps and {m} chairs a week, and the shop of {B} sells {k} tables during the winter sale",
    "In {n} years {A} will be {m} times as old as {B} was {k} years ago when both of them moved to the coast",
]


def filled(rng, template):
    a, b = rng.sample(PEOPLE, 2)
    return template.format(A=a, B=b, **{x: rng.randint(2, 12) for x in "nmkj"})


def test_recall_on_refilled_word_problems_and_clean_texts_of_the_same_shape(spark):
    rng = random.Random(12)
    items = [(i, filled(rng, t)) for i, t in enumerate(WORD_PROBLEMS)]
    texts, want = [], set()
    for i, template in enumerate(WORD_PROBLEMS):
        for _ in range(40):
            want.add((len(texts), i))
            texts.append(f"{rng.choice(['homework', 'please solve this', 'exercise seven'])}: {filled(rng, template)} {rng.choice(['thanks', 'show your work', ''])}")
    clean = len(texts)
    texts += [filled(rng, template) for template in OTHERS for _ in range(40)]
    got = set(found(spark, texts, items))
    assert len(got & want) >= 0.9 * len(want)
    assert not {pair for pair in got if pair[0] >= clean} and got <= want


def brute_templates(text, openers):
    """(kind, canonical word, value) of each word of the template form, or of that with openers, one word at a time."""
    out = []
    end = None
    for match in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text):
        word, gap = match[0], None if end is None else text[end : match.start()]
        end = match.end()
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        before = out[-1] if out else None
        opens = gap is None or any(c in ".!?:" for c in gap)
        name = len(word) > 1 and "A" <= word[0] <= "Z" and (word[1] >= "\x80" or "a" <= word[1] <= "z")
        if word.isascii() and word.isdigit():
            if before and before[0] == "number" and gap in (",", "."):
                before[2] += gap + word
                continue
            out.append(["number", "#", word])
        elif before and before[0] == "number" and low in decontaminate.UNITS:
            out.append(["unit", "%", low])
        elif name and (openers or not opens):
            if before and before[0] == "name" and not opens and not set(gap) - set(" \t\n\v\f\r-"):
                before[2] = None if before[3] else before[2] + " " + low
                continue
            out.append(["name", "@", low, opens])
        else:
            out.append(["word", low, low])
    return out


def brute_leaks(item, text):
    """Whether an item leaks into a text by literal windows or by one of the template forms."""
    def aligned(a, b, literal):
        size = min(8, len(a))
        if size < 4:
            return False
        windows = [i for i in range(len(a) - size + 1) if any(w[0] == "word" for w in a[i : i + size])]
        for shift in range(-len(a), len(b)):
            hits = [i for i in windows if 0 <= i + shift <= len(b) - size and all(x[1] == y[1] for x, y in zip(a[i : i + size], b[i + shift : i + shift + size], strict=True))]
            if not hits or len(hits) < min(3, len(windows)):
                continue
            if literal:
                return True
            places = sorted({j for i in hits for j in range(i, i + size)})
            ordinary = sum(a[j][0] == "word" for j in places)
            names = {(a[j][2], b[j + shift][2]) for j in places if a[j][0] in ("name", "unit") and a[j][2] is not None and b[j + shift][2] is not None}
            numbers = {(a[j][2], b[j + shift][2]) for j in places if a[j][0] == "number"}
            def single(pairs):
                return len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs)
            if ordinary >= min(5, len(a) - 1) and single(names) and (ordinary >= 5 or len({p[0] for p in numbers}) == len(numbers)):
                return True
        return False

    def literal(text):  # parts of a number like 1,250 are one word
        found = re.findall(r"[0-9]+(?:[.,][0-9]+)+(?![0-9A-Za-z\x80-\U0010ffff])|[0-9A-Za-z\x80-\U0010ffff]+", text)
        return [["word", w.lower(), w] for w in found]

    if aligned(literal(item), literal(text), True):
        return True
    for openers in (False, True):
        a = brute_templates(item, openers)
        if any(w[0] != "word" for w in a) and aligned(a, brute_templates(text, openers), False):
            return True
    return False


def test_template_rule_against_brute_force(spark):
    rng = random.Random(21)
    parts = ["the", "old", "car", "road", "runs", "and", "then", "Paris", "New York", "Lyon", "3", "12", "7", "60 km", "2 hours", "5 kg", "1,250", "green", "has", "box"]
    items = [(i, " ".join(rng.choices(parts, k=rng.randint(6, 16)))) for i in range(25)]
    texts = []
    for _ in range(150):
        words = rng.choice(items)[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            swap = {"Paris": "Rome", "Lyon": "Paris", "3": "8", "12": "3", "7": "7", "60": "80", "2": "9", "km": "miles", "1,250": "99"}
            words[at] = swap.get(words[at], rng.choice(parts) if rng.random() < 0.3 else words[at])
        texts.append(rng.choice(["", "so ", "first of all. ", "a "]) + " ".join(words) + rng.choice(["", " end", ". Then more"]))
    want = {(d, i) for d, text in enumerate(texts) for i, item in items if brute_leaks(item, text)}
    assert len(want) > 60
    assert set(found(spark, texts, items)) == want
