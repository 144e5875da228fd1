"""A gated recurrent unit with a class-factored softmax, in numpy.

Words are in classes; P(word) = P(class | state) P(word | class, state). A word of a class with one
member costs only its class. Output biases start at the logarithms of the counts, so an untrained model
is the unigram model of its vocabulary.
"""

from __future__ import annotations

import numpy as np

WINDOW = 16
#: Columns of class probabilities that are worked on at a time, so that they stay in the processor's cache.
_COLUMNS = 2048
_ADAM = (0.9, 0.99, 1e-6)


def classes_by_mass(counts: np.ndarray, n: int) -> np.ndarray:
    """Class of each word, for words in descending order of their counts: n runs of about equal sums of the counts' square roots."""
    mass = np.sqrt(counts + 1.0)
    done = np.cumsum(mass) - mass
    return np.minimum((done / mass.sum() * n).astype(np.int64), n - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def _log_softmax(logits: np.ndarray, bias: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Logarithm of the wanted row's probability in each column. logits are written over."""
    logits += bias
    logits -= logits.max(axis=0)
    out = logits[wanted, np.arange(len(wanted))]
    np.exp(logits, out=logits)
    out -= np.log(logits.sum(axis=0))
    return out


def _softmax_error(logits: np.ndarray, bias: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, float]:
    """Probabilities less one in the wanted row of each column, and the sum of losses. logits are written over."""
    logits += bias
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits *= 1 / logits.sum(axis=0)
    at = wanted, np.arange(len(wanted))
    right = logits[at]
    logits[at] = right - 1
    return logits, -np.log(right + 1e-30).sum()


class Gru:
    """Words have numbers 0 to V - 1, sorted by class; cls is the class of each. The last number starts a text and ends it."""

    NAMES = ("inputs", "gates", "class_out", "class_bias", "word_out", "word_bias")

    def __init__(self, counts: np.ndarray, cls: np.ndarray, hidden: int = 24, seed: int = 5):
        self.cls, self.hidden, self.end = cls, hidden, len(cls) - 1
        self.first = np.searchsorted(cls, np.arange(cls.max() + 2))
        rng = np.random.default_rng(seed)
        of_class = np.bincount(cls, counts + 1.0)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.inputs = (rng.standard_normal((len(cls), 3 * hidden)) * 0.3).astype(np.float32)
        self.gates = normal(hidden, 3 * hidden)
        self.class_out, self.class_bias = 0 * normal(hidden, len(of_class)), np.log(of_class / of_class.sum()).astype(np.float32)
        self.word_out, self.word_bias = 0 * normal(len(cls), hidden), np.log((counts + 1.0) / of_class[cls]).astype(np.float32)
        self.moments = None

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, weights: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(self, n, weights[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size

    def _step(self, word: np.ndarray, state: np.ndarray):
        """Next state (a row for each word), beside what led to it."""
        return tuple(x.T for x in self._advance(self.inputs.T[:, word], self.gates.T, state.T))

    def _advance(self, own: np.ndarray, gates: np.ndarray, state: np.ndarray):
        """_step() on columns: own are the inputs of the words. Slices of whole rows are contiguous, so that each operation is a plain loop."""
        h = self.hidden
        back = gates @ state
        sig = _sigmoid(own[: 2 * h] + back[: 2 * h])
        keep, reset, back = sig[:h], sig[h:], back[2 * h :]
        new = reset * back
        new += own[2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= keep
        after += new
        return after, keep, reset, new, back

    def _by_class(self, words: np.ndarray):
        """Rows of the words of classes with more than one word, by class, and (class, begin, end) among them for each such class."""
        cls = self.cls[words].astype(np.uint16)
        several = np.flatnonzero((np.diff(self.first) > 1)[cls])
        order = several[np.argsort(cls[several], kind="stable")]
        cuts = np.searchsorted(cls[order], np.arange(len(self.first), dtype=np.uint16)).tolist()
        return order, [(c, i, j) for c, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]

    def log_prob(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability after each state."""
        return self._log_prob(states.T, words)

    def _log_prob(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log_prob() with a column for each state."""
        out, cls, weights, bias = np.empty(len(words), np.float32), self.cls[words], np.ascontiguousarray(self.class_out.T), self.class_bias[:, None]
        for at in range(0, len(words), _COLUMNS):
            cut = slice(at, at + _COLUMNS)
            out[cut] = _log_softmax(weights @ states[:, cut], bias, cls[cut])
        order, runs = self._by_class(words)
        own, wanted, inside = states.take(order, axis=1), words[order], np.empty(len(order), np.float32)
        for c, i, j in runs:
            a, b = self.first[c], self.first[c + 1]
            inside[i:j] = _log_softmax(self.word_out[a:b] @ own[:, i:j], self.word_bias[a:b, None], wanted[i:j] - a)
        out[order] += inside
        return out.astype(np.float64)

    def score(self, texts: list[np.ndarray], window: int = WINDOW, beside: int = 512) -> np.ndarray:
        """Natural log-likelihood of each whole text and its end. Texts of like length advance side by side, and the state is carried to the end of the longest; probabilities are worked out for window * beside words at a time."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        total = np.zeros(len(texts))
        for at in range(0, len(order), beside):
            total[order[at : at + beside]] = self._score_sorted([texts[i] for i in order[at : at + beside]], window * beside)
        return total

    def _score_sorted(self, texts: list[np.ndarray], held: int) -> np.ndarray:
        lens = np.array([len(t) + 1 for t in texts])
        rows = np.concatenate([x for t in texts for x in (t, [self.end])]).astype(np.int32)
        starts = np.cumsum(lens) - lens
        inputs, gates = np.ascontiguousarray(self.inputs.T), np.ascontiguousarray(self.gates.T)
        total, state = np.zeros(len(lens)), np.zeros((self.hidden, len(lens)), np.float32)
        word = np.full(len(lens), self.end, np.int32)
        many = np.searchsorted(-lens, -np.arange(int(lens[0]))).tolist()  # texts that still have a word at each place
        states, words, active, at = np.empty((self.hidden, max(held, len(lens))), np.float32), [], [], 0

        def add_up():
            got, begin = self._log_prob(states[:, :at], np.concatenate(words)), 0
            for n in active:
                total[:n] += got[begin : begin + n]
                begin += n

        for t, n in enumerate(many):
            if at + n > states.shape[1]:
                add_up()
                words, active, at = [], [], 0
            state = self._advance(inputs.take(word[:n], axis=1), gates, state[:, :n])[0]
            word = rows[starts[:n] + t]
            states[:, at : at + n] = state
            words.append(word), active.append(n)
            at += n
        add_up()
        return total

    def train(self, words: np.ndarray, starts: np.ndarray, rate: float, last_rate: float, streams: int, window: int = WINDOW) -> float:
        """One pass over words (texts one after the other, each with its end); starts marks the first word of each text.

        The words are cut into streams that advance side by side. Errors go back through one window; the
        state goes on to the next one, and starts anew with each text. Words that fill no row of all
        streams are learned from in fewer streams. Returns the mean loss of a word.
        """
        before, done, loss = np.where(starts, self.end, np.roll(words, 1)), 0, 0.0
        while done < len(words):
            beside = max(1, min(streams, (len(words) - done) // (4 * window)))
            end = done + (len(words) - done) // beside * beside
            loss += self._pass(before[done:end], words[done:end], starts[done:end], rate if not done else last_rate, last_rate, beside, window)
            done = end
        return loss / max(1, len(words))

    def _pass(self, before, words, starts, rate: float, last_rate: float, streams: int, window: int) -> float:
        """train() on words that fill their streams; returns the sum of losses."""
        steps = len(words) // streams
        grid, fresh, before = (x.reshape(streams, steps) for x in (words, starts, before))
        state, loss, n_windows = np.zeros((streams, self.hidden), np.float32), 0.0, -(-steps // window)
        if self.moments is None:
            self.moments = {n: [np.zeros_like(getattr(self, n)) for _ in range(2)] for n in self.NAMES}
            self.updates = 0
        for k in range(n_windows):
            cut = slice(k * window, min(steps, (k + 1) * window))
            state, window_loss = self._learn(before[:, cut].T, grid[:, cut].T, fresh[:, cut].T, state, rate + (last_rate - rate) * k / n_windows)
            loss += window_loss
        return loss

    def _learn(self, before, after, fresh, state, rate) -> tuple[np.ndarray, float]:
        h, steps, streams = self.hidden, *before.shape
        inputs, gates, tape = np.ascontiguousarray(self.inputs.T).take(before.ravel(), axis=1), np.ascontiguousarray(self.gates.T), []
        state, places = state.T, [slice(t * streams, (t + 1) * streams) for t in range(steps)]
        olds, states, stay = np.empty((h, steps * streams), np.float32), np.empty((h, steps * streams), np.float32), [None if not x.any() else (~x).astype(np.float32) for x in fresh]
        for at, same in zip(places, stay):
            olds[:, at] = state if same is None else state * same
            state, *parts = self._advance(inputs[:, at], gates, olds[:, at])
            states[:, at] = state
            tape.append(parts)
        words = np.ascontiguousarray(after).ravel()
        grads = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        back_state, loss = self._output_grads(states, words, grads)
        carry = np.zeros_like(state)
        into_inputs, into_new = inputs, np.empty_like(olds)  # the errors take the place of the inputs
        for at, same, (keep, reset, new, back) in zip(places[::-1], stay[::-1], tape[::-1]):
            error, into = back_state[:, at] + carry, into_inputs[:, at]
            off = 1 - keep
            np.multiply(error, keep, out=carry)
            np.multiply((olds[:, at] - new) * off, carry, out=into[:h])
            d_new = (1 - new * new) * off
            d_new *= error
            into[2 * h :] = d_new
            d_new *= reset
            into_new[:, at] = d_new
            back *= d_new
            np.multiply(back, 1 - reset, out=into[h : 2 * h])
            carry += self.gates[:, : 2 * h] @ into[: 2 * h]
            carry += self.gates[:, 2 * h :] @ d_new
            if same is not None:
                carry *= same
        grads["gates"][:, : 2 * h] += olds @ into_inputs[: 2 * h].T
        grads["gates"][:, 2 * h :] += olds @ into_new.T
        wanted = before.ravel().astype(np.intp)
        for k, row in enumerate(into_inputs):
            grads["inputs"][:, k] = np.bincount(wanted, row, len(self.cls))
        self._update(grads, np.float32(1 / len(words)), rate)
        return state.T, loss

    def _output_grads(self, states, words, grads) -> tuple[np.ndarray, float]:
        """Errors of the states (columns), and the sum of losses."""
        cls, back, loss, weights = self.cls[words], np.empty_like(states), 0.0, np.ascontiguousarray(self.class_out.T)
        for at in range(0, len(words), _COLUMNS):
            cut = slice(at, at + _COLUMNS)
            logits, lost = _softmax_error(weights @ states[:, cut], self.class_bias[:, None], cls[cut])
            loss += lost
            grads["class_out"] += states[:, cut] @ logits.T
            grads["class_bias"] += logits.sum(axis=1)
            np.matmul(self.class_out, logits, out=back[:, cut])
        order, runs = self._by_class(words)
        own, wanted, inside = states.take(order, axis=1), words[order], np.empty((self.hidden, len(order)), np.float32)
        for c, i, j in runs:
            a, b = self.first[c], self.first[c + 1]
            logits, lost = _softmax_error(self.word_out[a:b] @ own[:, i:j], self.word_bias[a:b, None], wanted[i:j] - a)
            loss += lost
            grads["word_out"][a:b] += logits @ own[:, i:j].T
            grads["word_bias"][a:b] += logits.sum(axis=1)
            inside[:, i:j] = self.word_out[a:b].T @ logits
        back[:, order] += inside
        return back, float(loss)

    def _update(self, grads, scale, rate) -> None:
        fast, slow, least = _ADAM
        self.updates += 1
        step = rate * np.sqrt(1 - slow**self.updates) / (1 - fast**self.updates)
        for n, g in grads.items():
            g *= scale
            np.clip(g, -0.05, 0.05, out=g)
            m, v = self.moments[n]
            m += (1 - fast) * (g - m)
            v += (1 - slow) * (g * g - v)
            x = getattr(self, n)
            x -= (step * m / (np.sqrt(v) + least)).astype(np.float32)
