"""One step of joining segments to turns, for all forms that see segments one by one."""

from __future__ import annotations

MAX_GAP = 3.0
#: start, end, speaker, text
Turn = tuple[float, float, str | None, str]


def add_segment(held: Turn | None, start, end, speaker, text, max_gap: float = MAX_GAP) -> tuple[Turn | None, Turn | None]:
    """(the open turn, the turn that this segment closed).  Blank texts change nothing; a segment without a speaker joins none."""
    text = (text or "").strip()
    if not text:
        return held, None
    start = start if start is not None and start == start else 0.0
    end = max(start, end if end is not None and end == end else start)
    speaker = speaker.strip() if isinstance(speaker, str) and speaker else None
    if held and speaker is not None and held[2] == speaker and start - held[1] <= max_gap:
        return (held[0], max(held[1], end), speaker, f"{held[3]} {text}"), None
    return (start, end, speaker, text), held
