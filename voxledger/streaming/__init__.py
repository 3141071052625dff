"""File streams through the same functions as the batch jobs."""
