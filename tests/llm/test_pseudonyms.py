"""Pseudonyms against a plain Feistel network, across spellings, and beside a caller's own columns."""

from __future__ import annotations

import hashlib
import random
import re

from dialweave.llm import private_data
from dialweave.llm.private_data import ROUNDS


def permuted(values: list[int], radices: list[int], kind: str, key: str) -> list[int]:
    """The alternating network, a symbol at a time."""
    state = list(values)
    for r in range(1, ROUNDS + 1):
        rest = ",".join(str(v) for i, v in enumerate(state) if i % 2 != r % 2)
        for i, v in enumerate(state):
            if i % 2 == r % 2:
                said = "|".join([key, kind, str(len(state)), str(r), str(i), rest])
                state[i] = (v + int(hashlib.sha256(said.encode()).hexdigest()[:12], 16) % radices[i]) % radices[i]
    return state


def card(value: str, key: str) -> str:
    digits = [int(c) for c in value if c.isdigit()]
    middle = permuted(digits[1:-1], [10] * (len(digits) - 2), "card", key)
    body = [digits[0], *middle]
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(body)))
    new = iter([*body, -total % 10])
    return re.sub(r"\d", lambda _: str(next(new)), value)


def social(value: str, key: str) -> str:
    a, g, s = (int(x) for x in value.split("-"))
    area, group, serial = permuted([a - 1 - (a > 666), g - 1, s - 1], [898, 99, 9999], "social", key)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def texts(spark, values: list[str]) -> list[str]:
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r["text"] for r in private_data.pseudonymised(df, "k").orderBy("doc_id").collect()]


def test_cards_and_social_numbers_equal_the_plain_network(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005"]
    assert texts(spark, cards) == [card(c, "k") for c in cards]
    numbers = ["123-45-6789", "001-01-0001", "665-99-9999", "667-01-0001", "899-50-5000"]
    assert texts(spark, numbers) == [social(n, "k") for n in numbers]


def test_one_value_has_one_pseudonym_however_it_is_spelled(spark):
    plain = lambda s: re.sub(r"[\s().-]", "", s)
    for spellings in (
        ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
        ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
    ):
        got = texts(spark, spellings)
        assert len({plain(g) for g in got}) == 1 and plain(got[0]) != plain(spellings[0])
        # each keeps its own separators
        assert [re.sub(r"\w", "", g) for g in got] == [re.sub(r"\w", "", s) for s in spellings]
    home, abroad = texts(spark, ["555-123-4567", "+1 (555) 123-4567"])
    assert plain(abroad) == "+1" + plain(home) != "+15551234567"


def test_valid_social_numbers_become_valid_and_distinct(spark):
    draw = random.Random(3)
    areas = [a for a in range(1, 900) if a != 666]
    numbers = list({f"{draw.choice(areas):03}-{draw.randrange(1, 100):02}-{draw.randrange(1, 10000):04}" for _ in range(3000)})
    got = texts(spark, numbers)
    assert len(set(got)) == len(numbers)
    assert [g for g in got if not re.fullmatch(r"\d{3}-\d{2}-\d{4}", g) or re.search(r"^(000|666|9)|-00-|-0000$", g)] == []
    assert sum(a == b for a, b in zip(got, numbers)) < 5


def test_columns_of_the_caller_pass_through_whatever_their_names(spark):
    schema = "doc_id long, text string, _values string, _any string, _candidates int, _row string, _text string, _n long"
    df = spark.createDataFrame([(1, "card 4111111111111111", "mine", "yours", 3, "r", "t", 9), (2, None, None, None, None, None, None, None)], schema)
    got = private_data.pseudonymised(df, "k")
    assert got.columns == [*df.columns, "n_private", "private_kinds"]
    assert [got.schema[c].dataType for c in df.columns] == [f.dataType for f in df.schema]
    one = got.where("doc_id = 1").first()
    assert tuple(one)[2:8] == ("mine", "yours", 3, "r", "t", 9) and one["text"] == "card " + card("4111111111111111", "k")
