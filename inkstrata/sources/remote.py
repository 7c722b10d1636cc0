"""Calls to remote services: answers checked, passing failures told from lasting ones, and calls made again after a wait.

These run inside tasks, around the client or translator that the caller gives.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Sequence

# States of an answer after which a call may be made again, and how much of a message is told.
TOO_MANY, SERVER_ERROR = 429, 500
TOLD = 600


class RemoteError(Exception):
    """A service refused a call or kept failing; the message holds no secret."""


def told(message: str, secret: str = "") -> str:
    """A message on one line, cut, with the secret blanked out."""
    return " ".join((message.replace(secret, "<redacted>") if secret else message).split())[:TOLD]


def is_passing(error: Exception) -> bool:
    """Whether a call that failed so may work later: too many calls, the server's own fault, the network, an answer cut short."""
    state = getattr(error, "code", getattr(error, "status", None))
    if isinstance(state, int):
        return state == TOO_MANY or state >= SERVER_ERROR
    return isinstance(error, (OSError, json.JSONDecodeError))


def wait_seconds(attempt: int, most: float = 8) -> float:
    """Seconds to wait after the attempt of this number (from 1)."""
    return min(2.0 ** (attempt - 1), most)


def timed[**P, R](call: Callable[P, R], seconds: float) -> Callable[P, R]:
    """``call``, given up with a ``TimeoutError`` (which passes) after so many seconds. What was begun can't be stopped; its answer is dropped."""

    def made(*args: P.args, **kwargs: P.kwargs) -> R:
        got: list = []

        def run() -> None:
            try:
                got.append((call(*args, **kwargs), None))
            except BaseException as error:  # noqa: BLE001  it is raised again outside
                got.append((None, error))

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        thread.join(seconds)
        if not got:
            raise TimeoutError(f"no answer within {seconds:g} s")
        value, error = got[0]
        if error is not None:
            raise error
        return value

    return made


def retrying[**P, R](call: Callable[P, R], tries: int = 3, most: float = 8, then: Sequence[Callable[P, R]] = (), secret: str = "", pause: Callable[[float], None] = time.sleep) -> Callable[P, R]:
    """``call`` made up to ``tries`` times while it fails in passing, and after that each of ``then`` once.

    A lasting failure, and the last one of all, is a ``RemoteError``.
    """

    def made(*args: P.args, **kwargs: P.kwargs) -> R:
        last = tries + len(then)
        for attempt in range(1, last + 1):
            try:
                return (call if attempt <= tries else then[attempt - tries - 1])(*args, **kwargs)
            except Exception as error:
                if attempt == last or (attempt <= tries and not is_passing(error)):
                    raise RemoteError(told(str(error) or type(error).__name__, secret)) from None
                if attempt < tries:
                    pause(wait_seconds(attempt, most))
        raise RemoteError("a call needs at least one try")

    return made


def answer_of(raw: bytes) -> dict:
    """A service's JSON object; one with a code other than zero or none is an error."""
    answer = json.loads(raw.decode("utf-8", "replace"))
    if not isinstance(answer, dict):
        raise RemoteError("the service's answer is no JSON object")
    if answer.get("code") not in (0, None):
        raise RemoteError(told(f"the service's code is {answer['code']}: {answer.get('msg', '')}"))
    return answer
