"""State machines of live audio as pure step functions, shared by batch folds and streams."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass
class VadParams:
    threshold: float = 0.012
    min_silence: int = 8000  # samples
    min_speech: int = 3200
    strict: bool = False  # the demo's variant wants levels above, not at, the threshold


@dataclass
class VadState:
    active: bool = False
    speech: int = 0
    silence: int = 0


def vad_step(s: VadState, rms: float, samples: int, p: VadParams) -> tuple[bool, bool, bool]:
    """(speaking, started, ended) after a frame; onset counts consecutive voiced samples only."""
    voiced = rms > p.threshold if p.strict else rms >= p.threshold
    if not s.active:
        s.speech = s.speech + samples if voiced else 0
        s.active = s.speech >= p.min_speech
        s.silence = 0
        return s.active, s.active, False
    s.silence = 0 if voiced else s.silence + samples
    if s.silence >= p.min_silence:
        s.active, s.speech, s.silence = False, 0, 0
        return False, False, True
    return True, False, False


@dataclass
class SessionParams:
    vad: VadParams = field(default_factory=VadParams)
    pre_roll: int = 3200  # samples
    grace: int = 14_400
    gate: bool = True


@dataclass
class SessionState:
    vad: VadState = field(default_factory=VadState)
    last_seq: int = -1
    dropped: int = 0
    errors: int = 0
    held: list[int] = field(default_factory=list)  # sample counts of the pre-roll's frames
    speaking: bool = False
    pending: int = -1  # samples since a candidate end; -1 where there is none
    partial: str = ""
    frames: int = 0
    received: int = 0
    forwarded: int = 0
    partials: int = 0
    finals: int = 0
    first_partial_us: int = -1
    closed: bool = False


def session_step(s: SessionState, seq: int | None, us: int, rms: float, samples: int, text: str | None, end: bool, p: SessionParams) -> list[tuple[str, str]]:
    """Events (kind, text) of a frame: partial, final, or error.

    ``text`` is what the injected recogniser has heard so far. The end of speech is a
    candidate: it counts from 0 on the frame that ends speech, is cancelled by speech
    and becomes final at the grace period.
    """
    if s.closed:
        return [("error", "the session is closed")]
    if end:
        s.closed = True
        if s.partial:
            s.finals += 1
            return [("final", s.partial)]
        return []
    if seq is not None:
        if seq <= s.last_seq:
            s.errors += 1
            return [("error", f"sequence {seq} does not increase")]
        if s.last_seq >= 0:
            s.dropped += seq - s.last_seq - 1
        s.last_seq = seq
    s.frames += 1
    s.received += samples
    speaking, started, ended = vad_step(s.vad, rms, samples, p.vad)
    if s.pending >= 0 and (started or speaking):
        s.pending = -1
    sent = samples
    if not s.speaking:
        if p.gate:
            if not (started or speaking):
                s.held.append(samples)
                while len(s.held) > 1 and sum(s.held[1:]) >= p.pre_roll:
                    s.held.pop(0)
                return []
            sent += min(sum(s.held), p.pre_roll)
            s.held = []
        s.speaking = True
    s.forwarded += sent
    events = []
    if text and text.strip() and text != s.partial:
        events.append(("partial", text))
        s.partials += 1
        s.partial = text
        if s.first_partial_us < 0:
            s.first_partial_us = us
    if ended:
        s.pending = 0
    elif s.pending >= 0 and not speaking:
        s.pending += samples
    if 0 <= s.pending >= p.grace:
        if s.partial:
            events.append(("final", s.partial))
            s.finals += 1
        s.speaking, s.pending, s.partial = False, -1, ""
    return events


def to_dict(state) -> dict:
    return asdict(state)


def session_from(data: dict) -> SessionState:
    return SessionState(**{**data, "vad": VadState(**data["vad"])})


def vad_from(data: dict) -> VadState:
    return VadState(**data)


#: Legal next states of the microphone controller; a stale token never changes anything.
MICROPHONE = {"idle": ("starting",), "starting": ("live", "idle", "failed"), "live": ("stopping", "failed", "idle"), "stopping": ("finalizing", "idle", "failed"), "finalizing": ("idle", "failed"), "failed": ("idle", "starting")}


def microphone_step(state: tuple[str, int], event: str, token: int) -> tuple[tuple[str, int], bool]:
    """(state, token) after an event and whether it was taken."""
    now, current = state
    if event == "starting" and event in MICROPHONE[now]:
        return (event, token), True
    if token != current or event not in MICROPHONE[now]:
        return state, False
    return (event, token), True
