"""Query catalogue: the reference's operators over the supplied tables, with their SQL."""
