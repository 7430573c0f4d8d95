"""Signal kernels on NumPy arrays of shape (samples, channels): filter design, recursion, transforms."""

from __future__ import annotations

import numpy as np


def _butter_poles(order: int) -> np.ndarray:
    """Poles of the analogue Butterworth prototype, on the left half of the unit circle."""
    k = np.arange(order)
    return np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))


def butter_sos(order: int, cutoff, kind: str, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter.

    The prototype's poles are moved to the band by the usual frequency transforms and mapped by the bilinear one.
    Each pole pair forms a section with zeros at 0, at half the rate, or at the band's centre.
    """
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if np.any(edges <= 0) or np.any(edges >= fs / 2):
        raise ValueError("cutoffs must lie between 0 and half the sampling rate")
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    p = _butter_poles(order)
    if kind in ("lowpass", "highpass"):
        w0 = warped[0]
        poles = p * w0 if kind == "lowpass" else w0 / p
        zeros = np.zeros(0 if kind == "lowpass" else order, complex)
    elif kind in ("bandpass", "bandstop"):
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = (p if kind == "bandpass" else 1 / p) * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.concatenate((half + root, half - root))
        zeros = np.zeros(order, complex) if kind == "bandpass" else np.concatenate((np.full(order, 1j * centre), np.full(order, -1j * centre)))
    else:
        raise ValueError(f"unknown filter kind {kind}")
    z_poles = (2 * fs + poles) / (2 * fs - poles)
    z_zeros = np.concatenate(((2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(poles) - len(zeros))))
    sections = _pair(z_zeros, z_poles)
    # unit gain in the middle of the passband
    at = {"lowpass": 0.0, "highpass": np.pi, "bandstop": 0.0}.get(kind, 2 * np.arctan(np.sqrt(np.prod(warped)) / (2 * fs)) if kind == "bandpass" else 0.0)
    sections[0, :3] /= abs(response(sections, np.array([at]))[0])
    return sections


def _pair(zeros: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """Conjugate pole pairs, furthest from the unit circle first, each with the zeros left that are nearest."""
    upper = [q for q in poles if q.imag > 1e-9]
    real = sorted((q.real for q in poles if abs(q.imag) <= 1e-9), key=abs)
    pairs = [(q, np.conj(q)) for q in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    left, out = list(zeros), []
    for pair in sorted(pairs, key=lambda x: -max(abs(v) for v in x)):
        mine: list[complex] = []
        for _ in pair:
            j = min(range(len(left)), key=lambda i: abs(left[i] - (np.conj(mine[0]) if mine and abs(mine[0].imag) > 1e-9 else pair[0])))
            mine.append(left.pop(j))
        b, a = np.real(np.poly(mine)), np.real(np.poly(pair))
        out.append(np.concatenate((np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a))))))
    return np.array(out[::-1])


def notch_sos(freq: float, q: float, fs: float) -> np.ndarray:
    """A single section that removes ``freq`` with quality ``q``."""
    w = 2 * np.pi * freq / fs
    gain = 1 / (1 + np.tan(w / (2 * q)))
    c = -2 * np.cos(w)
    return np.array([[gain, gain * c, gain, 1.0, gain * c, 2 * gain - 1]])


def response(sos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Complex response at angular frequencies w."""
    z = np.exp(-1j * w)
    out = np.ones(len(w), complex)
    for b0, b1, b2, a0, a1, a2 in sos:
        out *= (b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z)
    return out


def steady_state(sos: np.ndarray) -> np.ndarray:
    """States (sections, 2) in which a constant input of 1 gives a constant output."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        second = (b2 - a2 * gain) * level
        out[i] = (b1 - a1 * gain) * level + second, second
        level *= gain
    return out


#: Samples that are filtered by one matrix product in long signals.
STEP = 128


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run (n, channels) samples through the sections; state is (sections, 2, channels).

    Long signals go by blocks: what a block puts out and the state it leaves are linear in its samples and
    the state before it, so both come from matrix products with the answers to unit samples and unit states.
    """
    y = np.array(x, float)
    state = np.array(np.broadcast_to(state, (len(sos), 2, y.shape[1])), float)
    whole = len(y) // STEP * STEP
    if whole < 4 * STEP:
        return _recursion(sos, y, state)
    from_samples, left = _recursion(sos, np.eye(STEP), np.zeros((len(sos), 2, STEP)))
    left = left.reshape(-1, STEP)
    units = np.eye(2 * len(sos)).reshape(len(sos), 2, -1)
    from_state, moved = _recursion(sos, np.zeros((STEP, 2 * len(sos))), units)
    moved, s = moved.reshape(2 * len(sos), -1), state.reshape(2 * len(sos), -1)
    for i in range(0, whole, STEP):
        block = y[i : i + STEP].copy()
        y[i : i + STEP] = from_samples @ block + from_state @ s
        s = left @ block + moved @ s
    y[whole:], state = _recursion(sos, y[whole:], s.reshape(state.shape))
    return y, state


def _recursion(sos: np.ndarray, y: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample by sample, all channels at once; sections one after the other."""
    y, state = y.copy(), state.copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s1, s2 = state[i]
        for n in range(len(y)):
            v = y[n].copy()
            out = b0 * v + s1
            s1 = b1 * v - a1 * out + s2
            s2 = b2 * v - a2 * out
            y[n] = out
        state[i] = s1, s2
    return y, state


def padding(sos: np.ndarray) -> int:
    n = 2 * len(sos) + 1
    return 3 * (n - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward through the sections, with the ends continued by odd reflection."""
    pad = padding(sos)
    if len(x) <= pad:
        raise ValueError(f"zero-phase filtering needs more than {pad} samples, not {len(x)}")
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    start = steady_state(sos)[:, :, None]
    y, _ = sos_filter(sos, ext, start * ext[0])
    y, _ = sos_filter(sos, y[::-1], start * y[-1])
    return y[::-1][pad : len(y) - pad]


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along axis 0."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=0) * h[:, None], axis=0)


def fk_mask(freqs: np.ndarray, waves: np.ndarray, v_min: float | None, v_max: float | None) -> np.ndarray:
    """Cells kept by apparent speed |f / k|; the cell 0 / 0 always is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        speed = np.abs(freqs[:, None] / waves[None, :])
    keep = np.ones(speed.shape, bool)
    if v_min is not None:
        keep &= (speed >= abs(v_min)) | np.isnan(speed)
    if v_max is not None:
        keep &= (speed <= abs(v_max)) | np.isnan(speed)
    return keep


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points between it and a higher sample on either side."""
    out = []
    for p in peaks:
        sides = []
        for part in (x[: p + 1][::-1], x[p:]):
            higher = np.flatnonzero(part > x[p])
            sides.append(part[: higher[0] if len(higher) else len(part)].min())
        out.append(x[p] - max(sides))
    return np.array(out)
