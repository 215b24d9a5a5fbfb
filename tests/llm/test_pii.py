"""What the field of the personal-data operator adds, and how it segments."""

import random

import numpy as np

from limpid.llm import pii


def luhn_card(draw):
    while True:
        digits = "".join(draw.choices("0123456789", k=16))
        if digits[0] != "0" and pii.luhn(digits):
            return digits


def entity(draw, kind, plain):
    """An entity as the rules find it, or in a form that they miss; other numbers for ``none``."""
    n = draw.randint
    if kind == "email":
        user, host, tld = draw.choice(["ann.lee", "bob", "c_smith", "dora"]) + str(n(1, 99)), draw.choice(["mail", "post", "firm-x", "site2"]), draw.choice(["com", "org", "net", "co.uk"])
        return f"{user}@{host}.{tld}" if plain else draw.choice([f"{user} (at) {host} (dot) {tld}", f"{user}(at){host}.{tld}", f"{user}[at]{host}[dot]{tld}"])
    if kind == "ip":
        return ("." if plain else "[dot]").join(str(n(1, 255)) for _ in range(4))
    if kind == "card":
        digits = luhn_card(draw)
        return draw.choice(["", " ", "-"] if plain else [".", "/", "_"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        parts = [str(n(1, 99)), str(n(100, 999)), str(n(100, 999)), str(n(1000, 9999))]
        return "+" + " ".join(parts) if plain else draw.choice(["00" + " ".join(parts), "+" + "/".join(parts)])
    return draw.choice([f"{n(1900, 2030)}", f"{n(1, 31)}.{n(1, 12)}.{n(1990, 2030)}", f"version {n(1, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(1, 999)} items", f"{n(1, 99)}%", f"EUR {n(1, 9999)},50", f"at {n(0, 23)}:{n(10, 59)}", f"page {n(1, 400)}", f"id {draw.getrandbits(60):x}", f"{n(1, 9)}/{n(1, 9)}"])


def labelled(seed, count, plain, written_as=None):
    draw, out = random.Random(seed), []
    some = lambda: " ".join(draw.choices("the order was sent to our office in may and it will be paid by them when we meet again near city hall".split(), k=draw.randint(2, 8)))
    for _ in range(count):
        text, spans = some(), []
        for _ in range(draw.randint(1, 3)):
            kind = draw.choice([*pii.KINDS, "none", "none"])
            text += " "
            written = written_as(draw, kind) if written_as else entity(draw, kind, plain)
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(written)))
            text += written + draw.choice(["", ",", "."]) + " " + some()
        out.append((text, spans))
    return out


def test_added_spans_are_right_and_few_are_missed(spark):
    """Trained on texts whose entities the rules find, held against entities that they miss: precision and recall of what is added."""
    docs = spark.createDataFrame([(t,) for t, _ in labelled(1, 400, True)], "text string")
    weights = pii.train(pii.training_samples(docs, "text", 400, 20, 80))
    right = wrong = missed = 0
    for text, spans in labelled(2, 600, False):
        base, found = pii.all_spans(text, weights)
        added, wanted = set(found) - set(base), set(spans) - set(base)
        right, wrong, missed = right + len(added & wanted), wrong + len(added - wanted), missed + len(wanted - added)
    assert right > 700
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95


def unseen(draw, kind):
    """Forms that neither the rules nor the training's rewriting know, and numbers that are no entity."""
    n = draw.randint
    if kind == "email":
        user, host, tld = draw.choice(["ann.lee", "bob", "c_smith"]) + str(n(1, 99)), draw.choice(["mail", "post", "firm-x"]), draw.choice(["com", "org", "net"])
        return draw.choice([f"{user} AT {host} DOT {tld}", f"{user} at {host} dot {tld}", f"{user}{{at}}{host}.{tld}", f"{user} <at> {host} <dot> {tld}", f"{user}(AT){host}(DOT){tld}"])
    if kind == "ip":
        return draw.choice(["(dot)", " dot ", "{dot}"]).join(str(n(1, 255)) for _ in range(4)) if draw.random() < 0.7 else "(.)".join(str(n(1, 255)) for _ in range(4))
    if kind == "card":
        digits = luhn_card(draw)
        size, mark = draw.choice([(3, ":"), (4, ":"), (4, "|"), (8, "/"), (2, "_"), (4, "--")])
        return mark.join(digits[i : i + size] for i in range(0, 16, size))
    if kind == "phone":
        return draw.choice([f"(0{n(10, 999)}) {n(100, 999)} {n(1000, 9999)}", f"0{n(10, 999)}-{n(100, 999)}-{n(1000, 9999)}", f"0{n(100, 999)}.{n(100, 999)}.{n(1000, 9999)}", f"(00{n(1, 99)}) {n(100, 999)} {n(100, 999)} {n(100, 999)}"])
    return draw.choice([f"{n(1900, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(10, 28)}.{n(10, 12)}.{n(1990, 2030)}", f"{n(2000, 2019)}-{n(2020, 2030)}", f"{n(1, 99)},{n(100, 999)}.{n(10, 99)}", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 9)}.{n(256, 999)}", f"at {n(2, 9)} dot points", f"No. {n(10000000, 99999999)}", f"{n(100, 999)} dot {n(1, 9)}", f"{draw.getrandbits(64):x}", f"meet at {n(1, 12)}", ".".join(str(n(256, 999)) for _ in range(4)), f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}"])


def test_forms_that_training_never_writes(spark):
    """Trained as before; precision and recall of what is added on other forms of entities, among numbers that are none."""
    docs = spark.createDataFrame([(t,) for t, _ in labelled(1, 400, True)], "text string")
    weights = pii.train(pii.training_samples(docs, "text", 400, 20, 80))
    right = wrong = missed = 0
    for text, spans in labelled(3, 600, False, unseen):
        base, found = pii.all_spans(text, weights)
        added, wanted = set(found) - set(base), set(spans) - set(base)
        right, wrong, missed = right + len(added & wanted), wrong + len(added - wanted), missed + len(wanted - added)
    assert right > 700
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95


def test_training_texts_are_bounded_and_distinct(spark):
    texts = [f"call +1 269 555 {i:04d} now" for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(texts[0],)] * 500 + [(None,), ("no sign",)], "text string")
    samples = pii.training_samples(docs, "text", 40, 20, 80)
    assert len({t for t, s in samples if t in texts}) == 40
    many = spark.createDataFrame([(" ".join(["x 1 y z v w u"] * 50),)], "text string")
    assert len(pii.training_samples(many, "text", 5, 20, 80)) <= 20 and pii.training_samples(docs.limit(0), "text", 5, 20, 80) == []


def segmentations(region, at=0):
    """All ways to cut tokens into candidates and single outside tokens."""
    if at == len(region.tokens):
        yield []
        return
    for rest in segmentations(region, at + 1):
        yield rest
    for c, (start, n, _) in enumerate(region.candidates):
        if start == at:
            for rest in segmentations(region, at + n):
                yield [c, *rest]


def test_best_segmentation_is_the_best_of_all():
    draw = random.Random(3)
    rng = np.random.default_rng(4)
    for _ in range(40):
        text = " ".join(draw.choice(["a@b.cc", "10.0.0.1", "(at)", "4111", "1111", "+12", "345", "so"]) for _ in range(draw.randint(1, 4)))
        tokens = [m.span() for m in pii.TOKEN.finditer(text)]
        weights = rng.normal(size=(5, len(pii.FEATURES)))
        region = pii.Region(text, tokens)
        inside, outside = region.scores(weights)

        def score(chosen):
            covered = {i for c in chosen for i in range(region.candidates[c][0], region.candidates[c][0] + region.candidates[c][1])}
            return sum(inside[c] for c in chosen) + sum(outside[i] for i in range(len(tokens)) if i not in covered)

        best = max(segmentations(region), key=score)
        want = [(pii.KINDS[k], region.tokens[i][0], region.tokens[i + n - 1][1]) for i, n, k in (region.candidates[c] for c in best)]
        assert pii.best_segments(text, tokens, weights) == want
