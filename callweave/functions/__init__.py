"""Column expressions; nothing in here starts a job or needs Python workers."""
