"""Operator 5 on repetitive texts: the search for runs is exact and stays linear."""

import random
import time

import numpy as np

from spendlake.llm import licences


def test_first_places_equal_a_scan():
    rng = random.Random(4)
    for _ in range(50):
        things = [rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(1, 80))]
        last, before = {}, []
        for p, x in enumerate(things):
            before.append(last.get(x, -1))
            last[x] = p
        firsts = licences.FirstPlaces(np.array(before))
        for start in sorted(rng.choices(range(len(things)), k=20), reverse=True):
            most = rng.randrange(1, 10)
            assert firsts.of(start, most).tolist() == [p for p in range(start, len(things)) if before[p] < start][:most]


def plain_best(t, words):
    """The best score of any run, by looking at every start and end."""
    sets = [licences.bigrams(x) for _, x in licences.all_templates()]
    best = 0.0
    for a in range(len(words) - 1):
        for s in sets:
            seen, common = set(), 0
            for g in zip(words[a:], words[a + 1:]):
                if g not in seen:
                    seen.add(g)
                    common += g in s
                    best = max(best, 2 * common / (len(seen) + len(s)))
    return best if best >= t.t else 0.0


def test_repetitive_texts_equal_all_runs():
    t = licences.Templates(licences.LicenceSettings())
    rng = random.Random(11)
    notices = [x for _, x in licences.all_templates() if len(x) < 200]
    for _ in range(12):
        filler = licences.TOKEN.findall(rng.choice(notices).lower())[:rng.randrange(2, 4)]
        words = []
        for _ in range(3):
            words += filler * rng.randrange(20, 60)
            notice = licences.TOKEN.findall(rng.choice(notices).lower())
            at = rng.randrange(len(notice) + 1)
            words += notice[:at] + filler * rng.choice([0, 0, 40]) + notice[at:]
        found = t.scan(" ".join(words))
        assert max((x[0] for x in found), default=0.0) == plain_best(t, words)


def test_long_repetitive_texts_take_linear_time():
    t = licences.Templates(licences.LicenceSettings())
    seconds = []
    for k in (10_000, 40_000):
        text = licences._MIT_GRANT + " of the software" * k + " rare end"
        start = time.process_time()
        t.scan(text)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * seconds[0] + 1, seconds
