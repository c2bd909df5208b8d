"""Where tables come from: files by their suffix, or the catalog."""

from .readers import FORMATS, LoadError, infer_format, load
from .scratch import cut, shared_folder
from .session import open_session

__all__ = ["FORMATS", "LoadError", "infer_format", "cut", "load", "open_session", "shared_folder"]
