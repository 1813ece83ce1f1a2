"""The session, typo and search jobs on streams."""
