"""DataFrame operators: series, queues, views, mutations."""
