"""Program-estate analytics and record operators as DataFrame functions."""
