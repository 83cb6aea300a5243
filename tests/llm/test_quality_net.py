"""The quality network: a text has one score, whatever is scored beside it; gradients are those of the loss."""

import random

import numpy as np

from helixframe.llm import quality

R = random.Random(12)


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def trained(texts):
    words = [t.decode("latin-1") for t in texts]
    y = np.array([i % 2 for i in range(len(words))])
    return quality.train([w.upper() if q else w for w, q in zip(words, y)], y, (100, 300))


def test_score_of_a_text_alone():
    text = lambda n: "".join(R.choices("abcdefg hij\nKLM.,!?0123éü", k=n)).encode()
    others = [text(R.choice([0, 1, 7, 40, 700, 9000])) for _ in range(300)]
    net, one = trained(others[:64]), text(600)
    alone = net.score(*joined([one]))[0]
    for _ in range(50):
        part = R.sample(others, R.randrange(0, 60))
        at = R.randrange(len(part) + 1)
        assert net.score(*joined([*part[:at], one, *part[at:]]))[at] == alone


def test_order_of_additions_does_not_matter():
    net = trained([b"abc def " * 9, b"xyz! 12 " * 7] * 20)
    data, offsets = joined([bytes(R.randrange(256) for _ in range(5000))])
    shuffled = quality.Net()
    shuffled.p, shuffled.shift = dict(net.p), net.shift
    swap = np.random.default_rng(1).permutation(quality.FILTERS)
    both = np.concatenate([swap, quality.FILTERS + swap])
    shuffled.p["K"], shuffled.p["c"], shuffled.p["A"] = net.p["K"][:, swap], net.p["c"][swap], net.p["A"][both]
    assert net.score(data, offsets)[0] == shuffled.score(data, offsets)[0]


def test_gradients_by_finite_differences():
    net, r = quality.Net(3), np.random.default_rng(3)
    net.p = {k: r.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    texts = [b"", b"Some words, 12", b"abc " * 300, bytes(r.integers(0, 256, 900, dtype=np.uint8))]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    data, offsets = joined(texts)

    def loss():
        padded, spans = net.windows(data, offsets)
        x, _ = net.features(net.respond(padded), *net.chunks(spans))
        z = np.maximum(x @ net.p["A"] + net.p["a"], 0) @ net.p["B"] + net.p["b"]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    found = net.step(data, offsets, y)
    for name, p in net.p.items():
        for at in r.choice(p.size, min(p.size, 25), replace=False):
            i, e = np.unravel_index(at, p.shape), 1e-6
            p[i] += e
            up = loss()
            p[i] -= 2 * e
            down = loss()
            p[i] += e
            assert abs((up - down) / (2 * e) - found[name][i]) < 1e-6, (name, i)
