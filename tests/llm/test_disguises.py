"""Disguised personal data that earlier patterns cut short."""

import pyarrow as pa
import pytest

from ledgerloom.llm import pii


def found(text):
    (_, every), = pii.spans_of(pa.array([text]))
    return [(k, text[a:b]) for k, a, b in every]


@pytest.mark.parametrize(
    "address",
    ["jane.doe [at] firm [dot] pl", "jane [at] firm.ai", "jane [at] firm.se", "jane at firm dot se", "jane [at] a.b.c.d.e.f.g.com", "a.b.c.d.e.f.g (at) firm (dot) museum", "jane at " + " dot ".join("abcdefgh") + " dot com"],
)
def test_any_ending_and_any_number_of_labels(address):
    assert ("email", address) in found(f"mail {address}, please")


def test_next_sentence_is_no_ending():
    assert ("email", "jane [at] firm [dot] com") in found("jane [at] firm [dot] com . Then more")


WORDS = "zero one two three four five six seven eight nine".split()
CARD, OTHER = "4111111111111111", "5500005555555559"


def spelled(digits, gap=" "):
    return gap.join(WORDS[int(c)] for c in digits)


@pytest.mark.parametrize("gap", ["\n", ", ", " "])
def test_neighbouring_cards_are_both_found(gap):
    a, b = spelled(CARD), spelled(OTHER)
    assert found(f"pay {a}{gap}{b} now") == [("card", a), ("card", b)]


def test_one_card_over_two_lines_is_still_found():
    text = spelled(CARD[:8]) + "\n" + spelled(CARD[8:])
    assert found(text) == [("card", text)]
    both = text + "\n" + spelled(OTHER)
    assert found(both) == [("card", text), ("card", spelled(OTHER))]


def test_many_cards_of_one_run():
    cards = [spelled(CARD, ", ")] * 9
    assert found(" . ".join(cards)) == [("card", c) for c in cards]


def test_every_rewritten_text_fires_the_trigger():
    import random

    rng = random.Random(1)
    some = ["jane", "firm", "com", "pl", "@", ".", " . ", " ", "\xa0", "\x0b", " at ", " dot ", "[at]", "(dot)", "one", "two", "three", "4", ",", "_", "-", "plus ", "\n"]
    texts = ["".join(rng.choices(some, k=rng.randrange(3, 14))) for _ in range(60_000)] + ["jane@firm . com", "jane . doe@firm.com", "jane at firm . com", "jane\xa0at\xa0firm\xa0dot\xa0com"]
    fast = pii.spans_of(pa.array(texts))
    whole = [pii.spans(t) for t in texts]
    assert [t for t, x, y in zip(texts, fast, whole) if x != y] == []
    assert sum(a != b for a, b in whole) > 50
    assert found("write jane@firm . com now") == [("email", "jane@firm . com")]


def spelled_ip(address):
    return " ".join("dot" if c == "." else WORDS[int(c)] for c in address)


@pytest.mark.parametrize("gap", [", ", "\n", " and ", " "])
def test_neighbouring_addresses_are_both_found(gap):
    a, b = spelled_ip("192.168.1.1"), spelled_ip("10.0.0.1")
    assert found(f"from {a}{gap}{b} on") == [("ip", a), ("ip", b)]


def test_identifiers_of_two_kinds_side_by_side():
    ip, card, phone = spelled_ip("192.168.1.1"), spelled(CARD), "plus " + spelled("4915123456789")
    for first, second in ((("ip", ip), ("card", card)), (("card", card), ("ip", ip)), (("phone", phone), ("ip", ip)), (("phone", phone), ("phone", phone)), (("ip", ip), ("phone", phone))):
        for gap in (", ", "\n", " and "):
            text = f"{first[1]}{gap}{second[1]}"
            assert found(text) == [first, second], text


def test_random_lists_of_identifiers():
    """Any number of disguised identifiers with words or list separators between them: each is found from end to end."""
    import random

    rng = random.Random(11)
    make = {
        "ip": lambda: spelled_ip(".".join(str(rng.randrange(256)) for _ in range(4))),
        "card": lambda: spelled(rng.choice([CARD, OTHER, "378282246310005"])),
        "phone": lambda: "plus " + spelled(str(rng.randrange(10**9, 10**11))),
        "email": lambda: f"{rng.choice(['jane', 'bob.k'])}{rng.choice([' [at] ', '(at)', ' at '])}{rng.choice(['corp', 'my.firm'])}{rng.choice([' [dot] ', ' dot '])}{rng.choice(['com', 'org', 'de'])}",
    }
    for _ in range(400):
        kinds = rng.choices(list(make), k=rng.randrange(2, 6))
        parts, text, want = [make[k]() for k in kinds], "", []
        for k, p in zip(kinds, parts):
            text += rng.choice(["; ", " and ", " or then "]) if text else ""
            want.append((k, p))
            text += p
        assert found(text) == want, text
