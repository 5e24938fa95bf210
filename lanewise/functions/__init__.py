"""Column expressions: geometry, boxes, scores, plates, clocks."""
