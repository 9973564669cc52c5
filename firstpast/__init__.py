"""Delivery-race analytics on Spark: who delivered first, how far behind was
everyone else, what did each source miss, and what did it deliver corrupted."""
