"""DataFrame -> DataFrame operators (``df.transform`` style)."""
