"""Where the operators' intermediate tables live: see canticle.storage."""

from canticle.storage import Scratch, filesystem, shared_dir

__all__ = ["Scratch", "filesystem", "shared_dir"]
