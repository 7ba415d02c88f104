"""Container files as rows, and rows as container files.

Files are read through Spark's own ``binaryFile`` reader, so any store that Spark
can open will do; a file's bytes are parsed where they are.
"""

from .files import read_media, save_files  # noqa: F401
