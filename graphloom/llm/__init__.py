"""Training-data operators on ``documents``; the rest of the library does not depend on them."""
