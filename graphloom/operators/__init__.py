"""Graph operators over directed edge tables."""
