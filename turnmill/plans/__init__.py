"""The registered queries over the reference's own operators, and their SQL twins."""
