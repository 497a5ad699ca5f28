"""A small character convolutional network in numpy: trained, calibrated and thresholded on labelled findings."""

from __future__ import annotations

import random
import string

import numpy as np

BEFORE, INSIDE, AFTER = 24, 72, 8
LENGTH = BEFORE + INSIDE + AFTER


def crop(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Views of a candidate with its surroundings: (characters, from, to) with one view per INSIDE characters."""
    return [(text[max(0, a - BEFORE) : min(end, a + INSIDE) + AFTER], a - max(0, a - BEFORE), min(end, a + INSIDE) - max(0, a - BEFORE)) for a in range(start, max(end, start + 1), INSIDE)]


def arrays(views: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    ids, inside = np.zeros((len(views), LENGTH), np.int64), np.zeros((len(views), LENGTH), np.float32)
    for i, (text, a, b) in enumerate(views):
        raw = text.encode("ascii", "replace").replace(b"\0", b"?")[:LENGTH]
        ids[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        inside[i, a:b] = 1
    return ids, inside


class CharCnn:
    """Embedding, one convolution, maximum and mean over the candidate's neighbourhood, one output."""

    def __init__(self, width: int = 5, embed: int = 8, filters: int = 16, seed: int = 11):
        r = np.random.default_rng(seed)
        self.width = width
        self.w = {
            "e": r.normal(0, 0.3, (128, embed)),
            "k": r.normal(0, (width * (embed + 1)) ** -0.5, (width * (embed + 1), filters)),
            "c": np.zeros(filters),
            "d": r.normal(0, 0.2, 2 * filters),
            "b": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, ids, inside):
        x = np.concatenate([self.w["e"][ids], inside[:, :, None]], axis=2)
        n, length, depth = x.shape
        cols = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.width + 1, self.width * depth)
        z = np.maximum(cols @ self.w["k"] + self.w["c"], 0)
        mid = self.width // 2
        m = inside[:, mid : mid + z.shape[1], None]
        count = np.maximum(m.sum(axis=1), 1)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0], (z * m).sum(axis=1) / count], axis=1)
        return x, cols, z, m, count, top, pooled, pooled @ self.w["d"] + self.w["b"][0]

    def fit(self, views, labels, epochs: int = 12, batch: int = 128, rate: float = 4e-3, seed: int = 5) -> None:
        """Logistic loss, Adam."""
        y = np.asarray(labels, float)
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, f = 0, self.w["c"].size
        for _ in range(epochs):
            order = r.permutation(len(y))
            for a in range(0, len(y), batch):
                pick = order[a : a + batch]
                ids, inside = arrays([views[i] for i in pick])
                x, cols, z, m, count, top, pooled, out = self._forward(ids, inside)
                g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[pick]) / len(pick)
                dp = g[:, None] * self.w["d"]
                dz = np.broadcast_to((dp[:, f:] / count)[:, None, :], z.shape) * m
                np.put_along_axis(dz, top[:, None, :], np.take_along_axis(dz, top[:, None, :], 1) + dp[:, None, :f], 1)
                dz = dz * (z > 0)
                dcols = (dz @ self.w["k"].T).reshape(len(pick), z.shape[1], self.width, x.shape[2])
                dx = np.zeros_like(x)
                for j in range(self.width):
                    dx[:, j : j + z.shape[1]] += dcols[:, :, j]
                de = np.zeros_like(self.w["e"])
                np.add.at(de, ids, dx[:, :, :-1])
                grads = {"e": de, "k": np.tensordot(cols, dz, ((0, 1), (0, 1))), "c": dz.sum((0, 1)), "d": g @ pooled, "b": np.array([g.sum()])}
                step += 1
                for k, d in grads.items():
                    m1[k] += 0.1 * (d - m1[k])
                    m2[k] += 0.001 * (d * d - m2[k])
                    self.w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, views, labels, recall: float) -> None:
        """Platt scaling on findings held out from ``fit``, then the highest threshold that keeps ``recall`` of the true ones."""
        out, y = self._scores(views), np.asarray(labels, float)
        s, t = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(s * out + t, -30, 30)))
            s -= 0.05 * np.mean((p - y) * out)
            t -= 0.05 * np.mean(p - y)
        self.scale, self.shift = float(s), float(t)
        true = np.sort(self.probability(views)[y > 0.5])
        self.threshold = float(true[int((1 - recall) * len(true))])

    def _scores(self, views) -> np.ndarray:
        """Outputs before calibration, a few hundred views at a time."""
        return np.concatenate([np.zeros(0), *(self._forward(*arrays(views[a : a + 256]))[-1] for a in range(0, len(views), 256))])

    def probability(self, views) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self._scores(views) + self.shift, -30, 30)))


def look_alike(words: list[str], length: int, seed: int) -> str:
    """Words put together to about the length of a secret: what an identifier, a path or a compound looks like. Empty where there are no words."""
    r, out = random.Random(seed), ""
    joint, turn = r.choice(["", "-", "_", "/", "+", "="]), r.choice([str, str.capitalize, str.lower])
    while words and len(out) < length:
        out += (joint if out else "") + turn(r.choice(words))
    return out[: max(length, 6)] + r.choice(["", "", str(r.randint(0, 99)), f"{joint}{r.randint(1900, 2030)}"]) if out else ""


def findings(count: int, seed: int) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Labelled findings made by rule: keys and tokens in their usual settings against look-alikes in prose."""
    r = random.Random(seed)
    syllables = "ba co de fi gu ha jo ke li mo nu pa qui ro sa te un ver wo xe ya zo er in on ent tion sch eau ment ción".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    b64, low, alnum = string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    views, labels = [], []
    for _ in range(count):
        yes = r.random() < 0.5
        if yes:
            value = r.choice(
                [
                    lambda: draw("0123456789abcdef", r.choice([32, 40, 64])),
                    lambda: draw(b64, r.randint(24, 64)) + r.choice(["", "=", "=="]),
                    lambda: draw(low, r.randint(20, 40)),
                    lambda: draw(alnum, r.randint(20, 48)),
                    lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + draw(alnum + "_-", r.randint(20, 36)),
                    lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16),
                    lambda: draw("0123456789ABCDEF", r.choice([16, 24, 32, 40])),
                    lambda: draw(alnum, r.randint(12, 19)),
                    lambda: "eyJ" + draw(alnum + "_-", r.randint(24, 70)),
                ]
            )()
            before = r.choice([f'{r.choice(["key", "token", "secret", "auth", "credential", "pwd"])}{r.choice([" = ", ": ", "=", "  "])}{r.choice(["", chr(34)])}', f"{prose(3)} ", "Bearer ", f"{prose(1)}: "])
            if r.random() < 0.2:  # passwords: marks among letters and digits, blanks where they are quoted
                marks, quoted = "!#$%&*@^~?,;:()<>[]{}|", r.random() < 0.5
                value = r.choice([
                    lambda: draw(alnum + marks, r.randint(8, 40)),
                    lambda: word() + draw(marks + string.digits, r.randint(2, 6)) + draw(alnum, r.randint(0, 12)) + r.choice(["", "-", "_"]) + word().capitalize(),
                    lambda: (draw(string.ascii_letters, r.randint(1, 3)) + draw(marks, r.randint(1, 2)) + draw(string.digits, r.randint(1, 2))) * r.randint(2, 30),
                    lambda: (" " if quoted else ".").join("".join({"a": "@", "o": "0", "e": "3", "i": "1", "s": "$"}.get(c, c) for c in word() + word()) for _ in range(r.randint(2, 4))) + r.choice("!#9"),
                ])()
                before = f'{r.choice(["password", "passwd", "pwd", "passphrase", "secret", "token", "db pwd"])}{r.choice([" = ", ": ", "="])}{chr(34) * quoted}'
        else:
            value = r.choice(
                [
                    lambda: "".join(word() for _ in range(5)) + str(r.randint(1, 99)),
                    lambda: "/".join([word(), word(), str(r.randint(1990, 2030)), word(), word()]),
                    lambda: "-".join([word(), word(), word(), word(), str(r.randint(1, 30))]),
                    lambda: "_".join([word(), word(), word(), word(), "v" + str(r.randint(1, 9))]),
                    lambda: r.choice("x-=_0a") * r.randint(20, 40) + r.choice(["", "1a"]),
                    lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z",
                    lambda: "".join(word().capitalize() for _ in range(6)) + str(r.randint(0, 9)),
                    lambda: r.choice(["your_token_here_1234567890", "example-key-placeholder-01", "insert_api_key_here_000", "changeme-changeme-changeme1"]),
                    lambda: "+".join(str(r.randint(1, 999)) + r.choice(["a", "b", "kg"]) for _ in range(6)),
                ]
            )()
            if r.random() < 0.15:  # ordinary values under names of settings and credentials
                value = r.choice([lambda: word() + word(), lambda: word() + "_" + word(), lambda: word() + str(r.randint(1, 99)), lambda: r.choice(["required", "optional", "undefined", "disabled", "expired", "missing"])])()[:40]
                value = value if len(value) >= 6 else value + "ing" * 2
                if r.random() < 0.3:  # what is said in quotes after such a name
                    value = prose(r.randint(2, 12)) + r.choice(["", ".", ",", "!"])
            before = r.choice([f'{r.choice(["password", "token", "secret", "auth", "mode", "name", "see"])}{r.choice([" = ", ": ", "="])}', f"{prose(3)} ", f"{prose(2)}. ", f"http://{word()}.example/", f"{prose(1)}: ", f"{prose(2)} ("])
        text = f"{prose(4)} {before}{value}{r.choice([' ', '. ', chr(34) + ' ', ', ', chr(10)])}{prose(3)}"
        at = text.index(value, len(before))
        got = crop(text, at, at + len(value))
        views += got
        labels += [int(yes)] * len(got)
    return views, labels
