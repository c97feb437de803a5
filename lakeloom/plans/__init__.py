"""Planning: profiles, keys, schema differences, shapes.  Data is only read through a few aggregate jobs."""
