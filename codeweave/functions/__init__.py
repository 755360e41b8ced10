from .hashing import stable_hash, unit_uniform  # noqa: F401
