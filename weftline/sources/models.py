"""Weight files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from weftline.config import FEATURES

#: fixed value: slots that polynomial models use
POLYNOMIAL_MASK = (1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0)


@dataclass(frozen=True)
class LinearModel:
    weights: tuple[float, ...]
    bias: float = 0.0

    def score(self, x) -> float:
        return sum(w * v for w, v in zip(self.weights, x)) + self.bias


@dataclass(frozen=True)
class PolynomialModel:
    degree: float
    gamma: float
    coef0: float
    rho: float
    vectors: tuple[tuple[float, tuple[float, ...]], ...]


def _weights(lines: list[str]) -> tuple[float, ...]:
    named = {}
    for line in lines:
        name, _, value = line.partition("\t")
        if name in FEATURES and value:
            named[name] = float(value)
    return tuple(named.get(n, 0.0) for n in FEATURES)


def load_rank(path: str) -> LinearModel:
    """Lines of name, tab, weight; unknown names are passed over, missing ones are 0; no bias."""
    return LinearModel(_weights(Path(path).read_text().splitlines()))


def load_merge(path: str) -> LinearModel:
    """The bias in the first line, then as :func:`load_rank`."""
    first, *rest = Path(path).read_text().splitlines()
    return LinearModel(_weights(rest), float(first))


def load_polynomial(path: str) -> PolynomialModel:
    """Text of a polynomial support vector machine: degree, gamma, coef0 and rho in the third, fourth, fifth and eighth line,
    support vectors (coefficient, then index:value) from the tenth; index k stands for slot k - 1, masked slots are 0."""
    lines = Path(path).read_text().splitlines()
    number = lambda i: float(lines[i].split()[-1])
    vectors = []
    for line in lines[9:]:
        coef, *cells = line.split()
        sv = [0.0] * len(FEATURES)
        for cell in cells:
            k, v = cell.split(":")
            if 1 <= int(k) <= len(FEATURES) and POLYNOMIAL_MASK[int(k) - 1]:
                sv[int(k) - 1] = float(v)
        vectors.append((float(coef), tuple(sv)))
    return PolynomialModel(number(2), number(3), number(4), number(7), tuple(vectors))
