"""Named queries over whole tables, with the SQL that gives the same rows."""
