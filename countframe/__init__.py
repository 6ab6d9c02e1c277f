from countframe.frame import CountFrame, UNKNOWN  # noqa: F401
