"""A deterministic offline client for tests of the model-call transport."""

import hashlib


STUB_FAILURE = "model service unavailable"


class StubClient:
    """Deterministic offline client for tests: a canned reply picked by the first 8 hex digits
    of the prompt's md5 (so SQL can restate the pick); prompts containing ``fail_marker``
    raise, like an unavailable service."""

    def __init__(self, replies: tuple[str, ...], fail_marker: str | None = None):
        self.replies = replies
        self.fail_marker = fail_marker
        self.calls = 0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        if self.fail_marker and self.fail_marker in prompt:
            raise RuntimeError(STUB_FAILURE)
        return self.replies[int(hashlib.md5(prompt.encode("utf-8")).hexdigest()[:8], 16) % len(self.replies)]
