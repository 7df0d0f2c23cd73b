"""The boosted trees that judge candidate spans: invented labelled candidates, fitting, calibrated thresholds.

Fitting takes a second on the driver; its sample is bounded by SAMPLES. The trees then become SQL expressions.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Kinds in the order of results; the first four have exact base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Labelled candidates, half to fit and half to calibrate; trees, depth, learning rate.
SAMPLES, TREES, DEPTH, RATE = 7000, 30, 3, 0.3
#: Formats of candidates; each is met as often as the others in either half.
MAKERS = 36
#: Share of true ones among what a threshold lets through, on the calibration half.
PRECISION = 0.99
FEATURES = ("length", "digits", "letters", "marks", "groups", "luhn", "variety", "cases", "hex", "sign", "phone_word", "secret_word", "mail_word", "card_word", "ip_word", "other_word", "kind", "zero", "domain")
#: Shapes: a number that begins with a zero, and an end as mail hosts have it.
ZERO, DOMAIN = r"^\(?0", r"(?i)(\.|\x20dot\x20)(com|org|net|edu|gov|info|io|de|fr|uk|es|it|nl|eu|example)$"
#: Words before a span that speak for a kind, or for another meaning. They are matched in lower case.
CONTEXT = {
    "phone_word": r"(phone|tel|call|mobile|fax|whatsapp|sms)[^a-z]*[a-z]{0,8}[^a-z]*$",
    "secret_word": r"(token|secret|passw(or)?d|passwd|pwd|api.?key|auth|bearer|key|credential)[^a-z0-9]{0,6}$",
    "mail_word": r"(mail|contact|write|reach)[^a-z]*[a-z]{0,8}[^a-z]*$",
    "card_word": r"(card|visa|master|credit|debit|amex)[^a-z]*[a-z]{0,8}[^a-z]*$",
    "ip_word": r"(ip|host|server|address|addr|ping)[^a-z]*[a-z]{0,8}[^a-z]*$",
    "other_word": r"(order|invoice|item|isbn|sku|version|commit|sha|md5|build|page|year|total|id|no\.?|nr\.?|part|serial|checksum|hash|digest)[^a-z0-9]{0,4}$",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return bool(digits) and total % 10 == 0


def describe(kind: str, text: str, before: str) -> list[float]:
    """The features of a candidate; pii.py has the same as SQL expressions."""
    digits = re.sub(r"[^0-9]", "", text)
    before = before.lower()
    return [
        float(len(text)),
        float(len(digits)),
        float(len(re.sub(r"[^A-Za-z]", "", text))),
        float(len(re.sub(r"[^ ().:@_+/=-]", "", text))),
        float(len(re.sub(r"[0-9]+", "9", re.sub(r"[^0-9]+", " ", text)).replace(" ", ""))),
        float(luhn(digits)),
        len(set(text)) / max(len(text), 1),
        float(bool(re.search("[a-z]", text))) + float(bool(re.search("[A-Z]", text))),
        float(bool(re.fullmatch("[0-9A-Fa-f]+", text))),
        float(text[:1] in ("+", "(")),
        *[float(bool(re.search(CONTEXT[c], before))) for c in FEATURES[10:16]],
        float(KINDS.index(kind)),
        float(bool(re.search(ZERO, text))),
        float(bool(re.search(DOMAIN, text))),
    ]


@dataclass(frozen=True)
class Node:
    """A leaf has a value; else rows with feature <= at go low."""

    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _candidates(rng: random.Random, n: int) -> list[tuple[str, str, str, bool]]:
    """(kind, text, before, whether it is personal), invented by formats."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    token = lambda k, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(k))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    filler = lambda: " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ", ", ". ", ": "])
    near = lambda *w: filler() + rng.choice(w) + rng.choice([" ", ": ", " is ", "="])

    def card() -> str:
        own = digits(15)
        own += next(c for c in "0123456789" if luhn(own + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(own[i : i + 4] for i in range(0, 16, 4))

    makers = [
        lambda: ("email", f"{word()}.{word()} at {word()} dot com", near("mail", "contact", "write"), True),
        lambda: ("email", f"{word()} (at) {word()}.{rng.choice(['com', 'org', 'net'])}", filler(), True),
        lambda: ("email", f"{word()}{digits(2)} [at] {word()}.org", filler(), True),
        lambda: ("email", f"{word()} at {word()} dot {word()}", filler(), False),
        lambda: ("email", f"{word()} at {word()}.{rng.choice(['com', 'org', 'net', 'de', 'io'])}", rng.choice([filler(), near("mail", "contact", "write")]), True),
        lambda: ("email", f"{word()} at {word()}.{word().capitalize()}", filler(), False),
        lambda: ("ip", ":".join(token(4) for _ in range(8)), filler(), True),
        lambda: ("ip", ":".join(token(rng.randint(1, 4)) for _ in range(rng.randint(5, 8))), near("ip", "host", "server"), True),
        lambda: ("ip", ":".join(digits(2) for _ in range(rng.randint(4, 5))), filler(), False),
        lambda: ("ip", ":".join(token(rng.randint(1, 2)) for _ in range(rng.randint(9, 14))), filler(), False),
        lambda: ("card", card().replace("-", ".") if rng.random() < 0.5 else card(), near("card", "visa", "credit"), True),
        lambda: ("card", digits(16), near("order", "invoice", "serial", "id"), False),
        lambda: ("card", digits(rng.randint(13, 19)), filler(), False),
        lambda: ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}", filler(), True),
        lambda: ("phone", rng.choice([" ", "-", "."]).join([digits(3), digits(3), digits(4)]), near("phone", "call", "tel", "mobile"), True),
        lambda: ("phone", rng.choice([" ", "-"]).join([digits(3), digits(3), digits(4)]), filler(), True),
        lambda: ("phone", "0" + digits(9), near("phone", "call", "tel", "fax"), True),
        lambda: ("phone", rng.choice([" ", "."]).join(["0" + digits(1), *[digits(2) for _ in range(4)]]), rng.choice([filler(), near("phone", "call", "tel")]), True),
        lambda: ("phone", " ".join(rng.choice("123456789") + digits(1) for _ in range(rng.randint(4, 6))), filler(), False),
        lambda: ("phone", " ".join(digits(rng.choice([1, 3, 4])) for _ in range(rng.randint(3, 5))), filler(), False),
        lambda: ("phone", digits(10), near("order", "invoice", "id", "isbn"), False),
        lambda: ("phone", digits(rng.randint(7, 12)), filler(), False),
        lambda: ("phone", f"{digits(4)}-{digits(2)}-{digits(2)}", filler(), False),
        lambda: ("phone", f"{digits(4)}-{digits(4)}", filler(), False),
        lambda: ("phone", f"{digits(2)}.{digits(2)}.{digits(4)}", filler(), False),
        lambda: ("phone", f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}", near("isbn", "sku", "part"), False),
        lambda: ("secret", token(rng.choice([16, 18, 20, 32, 40, 64])), near("token", "secret", "key") + rng.choice(["", '= "', '"']), True),
        lambda: ("secret", token(rng.choice([16, 18, 20, 24])), filler() + rng.choice(["password=", "passwd: ", "pwd=", "password = "]), True),
        lambda: ("secret", token(rng.choice([20, 32, 40]), base64), near("token", "api key", "auth", "bearer", "secret"), True),
        lambda: ("secret", token(rng.randint(100, 900), base64), near("token", "api key", "secret") + rng.choice(["", '"']), True),
        lambda: ("secret", "/".join(word() for _ in range(rng.randint(4, 40))), filler(), False),
        lambda: ("secret", token(40), near("commit", "sha", "checksum", "digest"), False),
        lambda: ("secret", token(rng.choice([32, 40, 64])), filler(), False),
        lambda: ("secret", word() + word() + word() + word(), filler(), False),
        lambda: ("secret", word() + word() + word() + word(), near("key", "token", "auth"), False),
        lambda: ("secret", digits(rng.randint(16, 30)), near("order", "id", "serial"), False),
    ]
    assert len(makers) == MAKERS
    return [makers[i % MAKERS]() for i in range(n)]


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    total_g, total_h = grad.sum(), hess.sum()
    best, choice = total_g**2 / (total_h + 1), None
    if depth and len(x) >= 20:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if len(cuts):
                gain = g[cuts] ** 2 / (h[cuts] + 1) + (total_g - g[cuts]) ** 2 / (total_h - h[cuts] + 1)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-6:
                    best, choice = gain[k], (f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    if choice is None:
        return Node(value=float(-RATE * total_g / (total_h + 1)))
    low = x[:, choice[0]] <= choice[1]
    return Node(0.0, choice[0], choice[1], _grow(x[low], grad[low], hess[low], depth - 1), _grow(x[~low], grad[~low], hess[~low], depth - 1))


def value(node: Node, row: np.ndarray) -> float:
    while node.low is not None:
        node = node.low if row[node.feature] <= node.at else node.high
    return node.value


@lru_cache(maxsize=1)
def fitted() -> tuple[tuple[Node, ...], dict[str, float]]:
    """The trees, and each kind's threshold on the sum of their values."""
    rows = _candidates(random.Random(11), SAMPLES)
    x = np.array([describe(k, t, b) for k, t, b, _ in rows])
    y = np.array([float(p) for *_, p in rows])
    half = np.arange(len(rows)) // MAKERS % 2 == 0
    trees, margin = [], np.zeros(len(rows))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x[half], (p - y)[half], (p * (1 - p))[half], DEPTH)
        trees.append(tree)
        margin += np.array([value(tree, r) for r in x])
    thresholds = {}
    for kind in KINDS:
        own = np.array([k == kind for k, *_ in rows]) & ~half
        order = np.argsort(-margin[own])
        true = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(true >= PRECISION)
        # In the middle between the last score let through and the next below.
        ranked = margin[own][order]
        k = int(good[-1]) if len(good) else -1
        thresholds[kind] = float("inf") if k < 0 else float((ranked[k] + ranked[min(k + 1, len(ranked) - 1)]) / 2)
    return tuple(trees), thresholds
